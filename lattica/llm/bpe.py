"""Byte-level BPE without regular expressions: vectorised pre-tokenisation and cached pair merging.

A batch of texts becomes one array of code points. Each is mapped to a symbol (its Unicode class, and
what follows where the pattern looks ahead). An automaton of eight states runs over the symbols; its
transition functions compose associatively, so blocks are composed side by side, the blocks' functions
are scanned by doubling, and a second pass over all blocks at once gives the state before every code
point and with it the token boundaries. The slices between boundaries are looked up in a cache, and those
not in it are merged together, one lowest-ranked pair of each at a time.

The pattern is that of the public 50k byte-level vocabulary: contractions, optional space and letters,
numbers or other characters, white space up to its last character, white space.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import spared
from lattica.llm.suffix_dedup import Spans

#: Code points per vectorised batch, cached slices per worker, those learnt lately, and bytes from which a slice is merged with a heap.
BATCH_CHARS = 1 << 18
CACHE_SLICES = 400_000
RECENT_SLICES = 50_000
LONG_SLICE = 48

# Unicode's White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CLASS_LETTER, _CLASS_NUMBER, _CLASS_OTHER, _CLASS_WHITE = range(4)
# Symbols: letter, number, other, a space before a non-space, white space before white space or the end,
# other white space before a non-space, an apostrophe before one or two letters of a contraction.
_LETTER, _NUMBER, _OTHER, _JOIN, _BLANK, _BREAK, _QUOTE1, _QUOTE2 = range(8)
# States: nothing to continue, a space that joins, letters, numbers, others, white space, one or two letters to come.
_DONE, _SPACE, _LET, _NUM, _OTH, _WS, _C1, _C2 = range(8)


@lru_cache(1)
def _classes() -> np.ndarray:
    major = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode()
    table = np.full(256, _CLASS_OTHER, np.uint8)
    table[ord("L")], table[ord("N")] = _CLASS_LETTER, _CLASS_NUMBER
    out = table[np.frombuffer(major, np.uint8)]
    out[_WHITE] = _CLASS_WHITE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and boundary by (symbol, state); symbols 8 to 15 are those that start a text."""
    step, cut = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        for symbol, run in ((_LETTER, _LET), (_NUMBER, _NUM), (_OTHER, _OTH)):
            step[symbol, state], cut[symbol, state] = run, state not in (run, _SPACE)
        for symbol, start in ((_QUOTE1, _C1), (_QUOTE2, _C2)):
            joins = state in (_OTH, _SPACE)
            step[symbol, state], cut[symbol, state] = (_OTH if joins else start), not joins
        step[_JOIN, state], step[_BLANK, state], step[_BREAK, state] = _SPACE, _WS, _DONE
        cut[_BLANK, state] = state != _WS
    for state, after in ((_C1, _DONE), (_C2, _C1)):
        step[_LETTER, state], cut[_LETTER, state] = after, False
    step[8:] = step[:8, :1]  # as after nothing, whatever came before
    return step, cut


_STEP, _CUT = _automaton()


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each code point; ``starts``: where texts start (none is empty)."""
    kind = _classes()[points]
    n = len(points)
    ends = np.zeros(n, bool)
    ends[np.r_[starts[1:] - 1, n - 1]] = True
    white = kind == _CLASS_WHITE
    inner = np.zeros(n, bool)  # white space whose next code point is none, or white space
    inner[:-1] = white[1:]
    inner |= ends
    out = kind.copy()
    out[white] = np.where(inner[white], _BLANK, np.where(points[white] == 0x20, _JOIN, _BREAK))
    at = np.flatnonzero(points == 0x27)
    if len(at):
        near, far = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
        a, b, has1 = points[near], points[far], ~ends[at]
        has2 = has1 & ~ends[near]
        out[at[has1 & np.isin(a, [ord(c) for c in "stmd"])]] = _QUOTE1
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[has2 & pair]] = _QUOTE2
    out[starts] += 8
    return out


def states_before(syms: np.ndarray, steps: int = 256) -> np.ndarray:
    """The automaton's state before each symbol, by an associative scan over transition functions."""
    n = len(syms)
    blocks = -(-n // steps)
    grid = np.zeros(blocks * steps, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, steps).T).astype(np.uint8) << 3
    flat = _STEP.ravel()
    fn = np.repeat(np.arange(8, dtype=np.uint8)[:, None], blocks, axis=1)
    for row in grid:  # a block's function: its symbols' functions, one after another
        fn = flat[row | fn]
    width = 1
    while width < blocks:  # inclusive scan: f then g
        later = fn[:, width:]
        fn = np.concatenate([fn[:, :width], np.take_along_axis(later, fn[:, :-width].astype(np.intp), axis=0)], axis=1)
        width *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = fn[_DONE, :-1]
    out = np.empty((steps, blocks), np.uint8)
    for i, row in enumerate(grid):
        out[i] = state
        state = flat[row | state]
    return out.T.ravel()[:n]


def boundaries(joined: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start, with the end, and how many there are before each of ``starts``.

    ``joined``: texts one after another, none empty; ``starts``: where they start, in code points.
    """
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    syms = symbols(points, starts)
    at = np.flatnonzero(_CUT.ravel()[(syms.astype(np.intp) << 3) | states_before(syms)])
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(size)])
    return place[np.append(at, len(points))], np.searchsorted(at, starts)


def slices(text: str) -> list[bytes]:
    """The pre-tokens of one text."""
    if not text:
        return []
    cuts = boundaries(text, np.zeros(1, np.int64))[0].tolist()
    data = text.encode("utf-8", "surrogatepass")
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Merger:
    """Merges slices by the ranks of a vocabulary, given as {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values, self.pairs = np.append(keys[order], 1 << 62), np.append(values[order], 0), pairs
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.token_size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [b"%d" % i for i in range(len(tokens))]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of ``words`` (none empty)."""
        out: list = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = np.array([r], np.int64)
            elif len(w) > LONG_SLICE:
                out[i] = self._by_heap(w)
            else:
                short.append(i)
        if short:
            for i, ids in zip(short, self._together([words[i] for i in short])):
                out[i] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], 1 << 40)

    def _together(self, words: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        ids = np.full((len(words), width), -1, np.int64)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), 1 << 40, np.int64)
        if width > 1:
            both = inside[:, 1:]
            left, right = ids[:, :-1][both], ids[:, 1:][both]
            rank[:, :-1][both] = self._rank(left, right)
        out: list = [None] * len(words)
        live = np.arange(len(words))
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            new = rank[row, best]
            done = new >= 1 << 40
            if done.any():
                for k in np.flatnonzero(done):
                    out[live[k]] = ids[k, : size[k]].copy()
                keep = ~done
                ids, rank, size, live, best, new = ids[keep], rank[keep], size[keep], live[keep], best[keep], new[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            width = int(size.max())
            ids, rank = ids[:, :width], rank[:, :width]
            shift = np.arange(width) > best[:, None]  # what follows the merged pair moves one to the left
            moved = np.concatenate([ids[:, 1:], np.full((len(live), 1), -1)], axis=1)
            ids = np.where(shift, moved, ids)
            moved = np.concatenate([rank[:, 1:], np.full((len(live), 1), 1 << 40)], axis=1)
            rank = np.where(shift, moved, rank)
            ids[row, best] = new
            size = size - 1
            right = np.minimum(best + 1, width - 1)
            rank[row, best] = np.where(best + 1 < size, self._rank(new, np.maximum(ids[row, right], 0)), 1 << 40)
            left = np.maximum(best - 1, 0)
            rank[row, left] = np.where(best > 0, self._rank(ids[row, left], new), rank[row, left])
        return out

    def _by_heap(self, word: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (x := get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[j]]))
            if before[i] >= 0 and (x := get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x is not None], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        total = int(size.sum())
        at = np.repeat(self.token_start[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        return self.blob[at].tobytes()


@lru_cache(4)
def merger(path: str) -> Merger:
    with open(path, "rb") as f:
        return Merger({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class Cached:
    """Encodes texts; ``encode(words)`` gives the ids of the slices that the cache lacks, one after another, and how
    many each has.

    The cache is a few flat arrays: sorted 64-bit hashes of slices, where their ids start, and how many. Slices
    learnt lately are in small arrays of the same form, which join the others when they are RECENT_SLICES.
    """

    def __init__(self, encode):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.old, self.new = ((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each of ``texts`` its ids, unsigned 32-bit."""
        group: list[str] = []
        held = 0
        for t in texts:
            group.append(t)
            held += len(t)
            if held >= BATCH_CHARS:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of ``hashes`` start, how many there are, and which are known."""
        start, size, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for keys, starts, sizes in (self.old, self.new):
            if len(keys):
                at = np.searchsorted(keys, hashes)
                at[at == len(keys)] = 0
                here = keys[at] == hashes
                start[here], size[here] = starts[at[here]], sizes[at[here]]
                known |= here
        return start, size, known

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        found, size = self.encode(words)
        need = self.used + len(found)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.flat[self.used : need] = found
        start = self.used + np.cumsum(size) - size
        self.used = need
        self.new = self._merged(self.new, (hashes, start, size))
        if len(self.new[0]) >= RECENT_SLICES:
            self.old, self.new = self._merged(self.old, self.new), tuple(x[:0] for x in self.new)

    @staticmethod
    def _merged(one: tuple, two: tuple) -> tuple:
        order = np.argsort(np.concatenate([one[0], two[0]]), kind="stable")
        return tuple(np.concatenate(pair)[order] for pair in zip(one, two))

    def _group(self, group: list[str]) -> Iterator[np.ndarray]:
        full = [t for t in group if t]
        if not full:
            yield from (np.zeros(0, np.uint32) for _ in group)
            return
        joined = "".join(full)
        lengths = np.fromiter(map(len, full), np.int64, len(full))
        cuts, first = boundaries(joined, np.cumsum(lengths) - lengths)
        data = joined.encode("utf-8", "surrogatepass")
        hashes, sample, which = np.unique(Spans(np.frombuffer(data, np.uint8)).hash(cuts[:-1], cuts[1:]), return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) > CACHE_SLICES:
            self._clear()
        start, size, known = self._find(hashes)
        if not known.all():
            new = sample[~known]
            self._learn(hashes[~known], [data[a:b] for a, b in zip(cuts[new].tolist(), cuts[new + 1].tolist())])
            start[~known], size[~known], _ = self._find(hashes[~known])
        start, size = start[which], size[which]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]))]
        edges = np.append(np.append(0, upto)[first], len(ids)).tolist()
        parts = iter(zip(edges, edges[1:]))
        for t in group:
            a, b = next(parts) if t else (0, 0)
            yield ids[a:b]


_ENCODERS: dict = {}


def rank_encoder(path: str) -> Cached:
    """Ids by a file of ranks; kept in the worker."""
    if path not in _ENCODERS:

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = merger(path).merge(words)
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

        _ENCODERS[path] = Cached(encode)
    return _ENCODERS[path]


OUTPUTS = {"ids": "array<int>", "offsets": "array<bigint>", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "decoded": "binary"}


def encode_documents(docs: DataFrame, ranks_path: str, outputs: tuple[str, ...] = ("ids", "offsets"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id and the ``outputs`` wanted of

    ids, offsets (byte offset of each token in the text), n_tokens, ids_sha256 (of the decimal ids joined
    by a space), decoded (the bytes that the ids decode to) and decoded_sha256.

    A null text counts as empty: no tokens. Every row gives one row; other columns are left out.
    ``ranks_path`` is read on the executors and must lie where they can read it.
    """
    fields = [docs.schema[id_col], *(f"{o} {OUTPUTS[o]}" for o in outputs)]
    schema = f"`{id_col}` {fields[0].dataType.simpleString()}, " + ", ".join(fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, m = rank_encoder(ranks_path), merger(ranks_path)
        for batch in batches:
            cols: dict[str, list] = {o: [] for o in outputs}
            for ids in encoder.ids([t or "" for t in batch.column(1).to_pylist()]):
                if "ids" in cols:
                    cols["ids"].append(ids.astype(np.int32))
                if "offsets" in cols:
                    size = m.token_size[ids]
                    cols["offsets"].append(np.cumsum(size) - size)
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(ids))
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(b" ".join(map(m.decimal.__getitem__, ids.tolist()))).hexdigest())
                if "decoded" in cols or "decoded_sha256" in cols:
                    data = m.decode(ids)
                    if "decoded" in cols:
                        cols["decoded"].append(data)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(data).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "offsets": pa.list_(pa.int64()), "n_tokens": pa.int64(), "decoded": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[o], kinds.get(o, pa.string())) for o in outputs)], names=[id_col, *outputs])

    return docs.select(id_col, text_col).mapInArrow(spared(run), schema)
