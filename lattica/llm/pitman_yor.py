"""Hierarchical Pitman-Yor language model: restaurants seated by Gibbs sampling, averaged predictions.

A token is a word or the end of a text. Its context is the word before it, or the start of the text, and every
context has a restaurant of its own. A context restaurant's customers are its tokens; its tables are customers of the
one parent restaurant, the empty context, whose tables draw from a base: the unknown word as often as known
words were seen once, else a known word, all alike. A sweep draws the table counts of half of all (context, word) rows again, each for all its
customers at once and given all other rows, and those of the parent's words. Discounts are estimated for
either level from the counts; predictive probabilities of several samples are averaged.

Texts are read once, in blocks: a block keeps its texts as places in its list of words, and lists these by
hash (of V words about V^2 / 2^65 pairs collide). Words are dealt to parts by their hash and numbered there, all
in the order of hashes, so that numbers depend on the words alone. With these a block counts its
(word, context) pairs and sends them, packed, to the words' parts. Parts merge and seat their words; tables of a
context, whose words lie in many parts, are summed up between rounds of sweeps, where the context's number says,
and go back to the parts that seat any of its rows. At the end a part tells each block what it knows of the
block's words, as words, contexts and pairs. Nothing is held by context anywhere but for a range of
numbers. Random numbers are hashes of the row and the sweep, so that neither blocks nor parts nor retries change a score.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from copy import copy
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import give_back, packed, partitions, spared, stage, stage_by, unpacked, unstage

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Classes of word hashes by which tests name contexts.
LEAST_CLASSES = 1 << 10
#: Bytes of text of a block, and bytes of text for each part of the words.
BLOCK_BYTES, PART_BYTES = 8 << 20, 6 << 20
#: Parts that one task seats, and parts whose words' tables, as contexts, are summed up together (from LEAST_RANGES such ranges on).
PARTS_A_TASK, PARTS_A_RANGE, LEAST_RANGES = 4, 64, 16
STRENGTH, ROOT_STRENGTH = 2.0, 1.0
#: Rounds of sweeps before the samples, sweeps a round, samples, and sweeps between them.
ROUNDS, SWEEPS, SAMPLES, APART = 3, 4, 4, 2
#: Customers of a row up to which its tables are drawn from their exact distribution, and its cells held at a time; numbers of tables judged singly beyond.
EXACT, STEP_CELLS, GRID = 256, 1 << 20, 32


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Block:
    """Texts as places in the list of their words, which is in the order of the words' hashes."""

    def __init__(self, bits: int):
        """``bits``: a word's part is told by so many leading bits of its hash."""
        self.bits = bits
        self.words: defaultdict[bytes, int] = defaultdict(count(1).__next__, {b"": 0})  # the end
        self.texts: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        words = data.split()
        words.append(b"")
        self.tokens.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.texts.append((doc_id, held_out(doc_id), len(self.tokens[-1])))
        self.held += len(data) + 64

    def rows(self, name: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each text (part -1) and one for each part with words of the block."""
        if not self.texts:
            return
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        names, n = ["block", "part", "doc_id", "held_out", "n_tokens", "data"], len(self.texts)
        for a in range(0, n, 1000):
            z = min(n, a + 1000)
            ids, held, sizes = zip(*self.texts[a:z])
            data = [packed(rank[t]) for t in self.tokens[a:z]]
            yield pa.RecordBatch.from_arrays([pa.array([name] * (z - a), pa.int64()), pa.array([-1] * (z - a), pa.int32()), pa.array(ids, kind), pa.array(held), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=names)
        hashes = hashes[order]
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.append(np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part))
        data = [packed(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        n = len(data)
        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(part[cuts[:-1]], pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), pa.array(data, pa.binary())], names=names)


def blocks(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of texts and of words of all blocks of ``docs`` (doc_id, text)."""
    spark_kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, block, kind = TaskContext.get().partitionId(), 0, Block(bits), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(i, t.as_py() or "")
                if block.held >= BLOCK_BYTES:
                    yield from block.rows(task << 32 | made, kind)
                    made, block = made + 1, Block(bits)
        if kind is not None:
            yield from block.rows(task << 32 | made, kind)

    return docs.mapInArrow(spared(run), f"block bigint, part int, doc_id {spark_kind.simpleString()}, held_out boolean, n_tokens bigint, data binary")


def ranked(words: DataFrame) -> DataFrame:
    """(block, part, data, size): places of the blocks' words (block, part, data) among all words of a part, and how many these are."""

    def run(group: pa.Table) -> pa.Table:
        hashes = [np.cumsum(unpacked(x.as_py())[0], dtype=np.uint64) for x in group["data"]]
        every = np.unique(np.concatenate(hashes))
        data = [packed(np.diff(np.searchsorted(every, h), prepend=0).astype(np.uint32)) for h in hashes]
        return pa.table({"block": group["block"], "part": group["part"], "data": pa.array(data, pa.binary()), "size": pa.array([len(every)] * len(data), pa.int64())})

    return words.select("block", "part", "data").groupBy("part").applyInArrow(run, "block bigint, part int, data binary, size bigint")


def paired(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts: words of its distinct pairs, contexts (0: the start, else a word and 1), the pair of each token, sizes of texts."""
    tokens = [unpacked(x.as_py())[0] for x in texts]
    sizes, flat = np.array([len(t) for t in tokens]), np.concatenate(tokens)
    pair = flat.astype(np.int64) << 32
    pair[1:] += flat[:-1] + np.uint32(1)
    starts = np.cumsum(sizes) - sizes
    pair[starts] = flat[starts].astype(np.int64) << 32
    del tokens, flat
    pair, local = np.unique(pair, return_inverse=True)
    return pair >> 32, pair & 0xFFFFFFFF, local.astype(np.int32), sizes


def counted(texts: DataFrame, ranks: DataFrame, offsets: np.ndarray) -> DataFrame:
    """(block, part, data): pairs of the blocks' ``texts`` with their training counts; contexts by number (0: the start)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()  # what the group before held
        right = right.sort_by("part")
        own = [np.cumsum(unpacked(x.as_py())[0], dtype=np.int64) for x in right["data"]]
        parts, many = right["part"].to_numpy(), np.array([len(x) for x in own])
        number = 1 + np.concatenate(own) + np.repeat(offsets[parts], many)
        word, context, local, sizes = paired(left["data"])
        count = np.bincount(local[np.repeat(~left["held_out"].to_numpy(), sizes)], minlength=len(word)).astype(np.uint32)
        context = np.append(0, number)[context]
        lead = np.r_[True, word[1:] != word[:-1]]  # every word of a block has pairs
        context = np.where(lead, context, np.diff(context, prepend=0)).astype(np.uint32)
        each = np.bincount(word, minlength=len(number)).astype(np.uint32)
        cuts = np.append(0, np.cumsum(many))
        first = np.searchsorted(word, cuts).tolist()
        data = [packed(np.diff(x, prepend=0).astype(np.uint32), each[a:b], context[i:j], count[i:j]) for x, a, b, i, j in zip(own, cuts, cuts[1:], first, first[1:])]
        return pa.table({"block": right["block"], "part": right["part"], "data": pa.array(data, pa.binary())})

    return texts.select("block", "held_out", "data").groupBy("block").cogroup(ranks.select("block", "part", "data").groupBy("block")).applyInArrow(run, "block bigint, part int, data binary")


class Counts:
    """Training counts of the distinct (word, context) pairs of one part, from its blocks' rows."""

    def __init__(self, rows: list[bytes]):
        keys, counts, self.sizes, self.each = [], [], [], []
        for data in rows:
            delta, each, context, count = unpacked(data)
            context = np.cumsum(context, dtype=np.int64)
            end = np.cumsum(each, dtype=np.int64)
            before = np.append(0, context[end[:-1] - 1])
            keys.append(np.repeat(np.cumsum(delta, dtype=np.int64) << 32, each) | context - np.repeat(before, each))
            counts.append(count)
            self.sizes.append(len(context))
            self.each.append(each)
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key = key[order]
        lead = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(lead) - 1
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = group
        self.count = np.bincount(group, count[order]).astype(np.int64)
        key = key[lead]
        self.context = key & 0xFFFFFFFF
        name = key >> 32
        new_word = np.r_[True, name[1:] != name[:-1]]
        self.word = np.cumsum(new_word) - 1
        self.ranks = name[new_word]
        self.total = np.bincount(self.word, self.count).astype(np.int64)


@lru_cache(2)
def _stirling(d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of discount ``d``: seatings of c customers at t tables, at [c, t]."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT + 1):
        more = np.log(np.maximum(c - 1 - d * t, 1e-300))
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], np.where(t < c, out[c - 1, 1:] + more, -np.inf))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series seven up."""
    x = np.asarray(x, float)
    y = x + 7
    low = sum(np.log(x + k) for k in range(7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - low


def _stirling_at(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """As ``_stirling``, for any c > t > 0 (``c``: one for each row of ``t``): by its alternating sum up to
    2 c ** d tables, beyond by saddle point (found by halving log(x / (1 - x))); either where it is needed alone."""
    c = c.ravel()
    out, near = np.empty(t.shape), t <= (2 * c**d).reshape(-1, *[1] * (t.ndim - 1))
    row = np.nonzero(near)[0]
    few, total, choose, most = t[near], np.zeros(len(row)), np.ones(len(row)), _log_gamma(c - d)
    for j in range(1, 61):
        choose = choose * (few - j + 1) / j
        total += choose * ((-1) ** (j + 1) * np.exp(_log_gamma(np.maximum(c - d * j, 1e-3)) - most + _log_gamma(1.0 + d * j)) * np.sin(np.pi * d * j) / np.pi)[row]
    out[near] = np.log(np.maximum(total, 1e-300)) + most[row]
    row = np.nonzero(~near)[0]
    t_far, c_far = t[~near], c[row]
    low, high, z, most = np.full(len(row), -60.0), np.full(len(row), 120.0), np.zeros(len(row)), np.log(c_far / t_far)
    for _ in range(50):
        z = (low + high) / 2
        up = np.logaddexp(0, z)
        over = z - up + np.log(d) + (1 - d) * up - np.log(-np.expm1(-d * up)) > most
        low, high = np.where(over, low, z), np.where(over, z, high)
    up, m = np.logaddexp(0, z), c_far / t_far
    spread = np.maximum(c_far * (1 + (1 - d) * np.exp(z)) - c_far * m, 1e-3)
    out[~near] = t_far * np.log(-np.expm1(-d * up)) + c_far * np.logaddexp(0, -z) - 0.5 * np.log(2 * np.pi * spread) + _log_gamma(c_far + 1)
    return out - _log_gamma(t + 1) - t * np.log(d)


class Grid:
    """Numbers of tables that rows of more than EXACT customers can have: the first singly, others in cells."""

    def __init__(self, count: np.ndarray, d: float):
        count = count[count > EXACT]
        half = np.broadcast_to(np.arange(GRID) + 0.5, (len(count), GRID))
        self.edges = np.concatenate([half, half[:, -1:] * np.exp(np.linspace(0, 1, 2 * GRID)[1:] * np.log(count[:, None] / half[:, -1:]))], axis=1)
        self.tables = np.sqrt(self.edges[:, 1:] * self.edges[:, :-1])
        self.tables[:, : GRID - 1] = np.arange(1, GRID)
        self.ways = _stirling_at(d, count[:, None].astype(float), self.tables) if len(count) else self.tables

    def __getitem__(self, rows: np.ndarray) -> Grid:
        out = object.__new__(Grid)
        out.edges, out.tables, out.ways = self.edges[rows], self.tables[rows], self.ways[rows]
        return out


def draw(count: np.ndarray, d: float, weight: np.ndarray, first: np.ndarray, more: np.ndarray | None, rest: np.ndarray | None, chance: np.ndarray, grid: Grid) -> np.ndarray:
    """Numbers of tables of rows of ``count`` (over 1) customers, from their distribution at ``chance`` (in 0 to 1).

    ``weight``: of a new table before any of the row's; ``first``: the parent's probability of the dish (times
    ``rest``) for the row's first table, and ``more`` + k for the k-th after it, over ``rest`` + k; without these,
    ``first`` for each. Rows of more than EXACT customers are drawn on ``grid``, in which they come in turn.
    """
    tables = np.ones(len(count), np.int64)
    few = np.flatnonzero(count <= EXACT)
    few = few[np.argsort(count[few], kind="stable")]
    cut = np.flatnonzero(np.diff(count[few])) + 1
    for rows in np.split(few, cut) if len(few) else []:
        c = int(count[rows[0]])
        k, ways = np.arange(c), _stirling(d)[c, 1 : c + 1]
        for i in range(0, len(rows), max(1, STEP_CELLS // c)):
            r = rows[i : i + max(1, STEP_CELLS // c)]
            up = np.log(weight[r, None] + d * k)
            if more is None:
                up += np.log(first[r, None])
            else:
                up[:, 0] += np.log(first[r])
                up[:, 1:] += np.log(more[r, None] + k[1:])
                up -= np.log(rest[r, None] + k)
            p = np.cumsum(up, axis=1) + ways
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            tables[r] = 1 + (p < chance[r, None] * p[:, -1:]).sum(axis=1)
    many = np.flatnonzero(count > EXACT)
    if len(many):
        edge, t, w = grid.edges, grid.tables, weight[many, None] / d
        p = grid.ways + t * np.log(d) + _log_gamma(w + t) - _log_gamma(w)
        if more is None:
            p += t * np.log(first[many, None])
        else:
            p += _log_gamma(more[many, None] + t) + _log_gamma(rest[many, None]) - _log_gamma(rest[many, None] + t)
        p += np.log(np.diff(edge))
        p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
        spot = chance[many] * p[:, -1]
        at = np.minimum((p < spot[:, None]).sum(axis=1), t.shape[1] - 1)
        one = np.arange(len(many))
        low = np.where(at > 0, p[one, at - 1], 0)
        share = np.clip((spot - low) / np.maximum(p[one, at] - low, 1e-300), 0, 1)
        tables[many] = np.clip(np.rint(edge[one, at] + share * (edge[one, at + 1] - edge[one, at])), 1, count[many])
    return tables


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def chances(name: np.ndarray, sweep: int, which: int) -> np.ndarray:
    """Numbers in 0 to 1 for hashes of rows and a sweep."""
    salt = _mix(np.array([sweep * 4 + which + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((_mix(name ^ salt) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def base(words: int, hapaxes: int) -> tuple[float, float]:
    """The base's probability of each known word and of the unknown one, of ``words`` known, ``hapaxes`` seen once."""
    unknown = (hapaxes + 1) / (words + 2) if words else 1.0
    return (1 - unknown) / max(1, words), unknown


class Whole:
    """What all parts share: discounts, sizes, and totals as of the last exchange; ``tables``: those of a part's contexts."""

    def __init__(self, d: float, d0: float, words: int, hapaxes: int, tables: np.ndarray | None, root_tables: int, root_customers: int | None = None):
        self.d, self.d0 = d, d0
        self.base, self.unknown = base(words, hapaxes)
        self.tables, self.root_tables = tables, float(root_tables)
        self.root_customers = float(tables.sum() if root_customers is None else root_customers)

    def of(self, tables: np.ndarray) -> Whole:
        out = copy(self)
        out.tables = tables
        return out


class Seating:
    """Tables of the rows of more than one customer of a part, and of its words in the parent restaurant."""

    def __init__(self, hashes: np.ndarray, each: np.ndarray, singles: np.ndarray, context: np.ndarray, count: np.ndarray, tables: np.ndarray, roots: np.ndarray, contexts: np.ndarray | None = None):
        """By word: number, rows, rows of one customer, tables in the parent; by row: place of its context, customers, tables; ``contexts``: their numbers."""
        self.hashes, self.each, self.singles, self.context, self.count, self.tables, self.roots = hashes, each, singles, context, count, tables, roots
        self.contexts = np.arange(context.max(initial=-1) + 1) if contexts is None else contexts
        self.word = np.repeat(np.arange(len(each)), each)
        self.grid: Grid | None = None  # of the rows, whose customers and discount stay
        self.name = _mix(hashes[self.word] + (self.contexts[context].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))

    @classmethod
    def start(cls, counts: Counts, first: int) -> Seating:
        """One table a row and one a word; ``first``: the number of the part's first word."""
        known = counts.total > 0
        number = np.cumsum(known) - 1
        rows = np.flatnonzero(counts.count > 1)
        word = number[counts.word[rows]]
        n = int(known.sum())
        singles = np.bincount(number[counts.word[counts.count == 1]], minlength=n)
        contexts, context = np.unique(counts.context[rows], return_inverse=True)
        return cls((first + counts.ranks[known]).astype(np.uint64), np.bincount(word, minlength=n), singles, context, counts.count[rows], np.ones(len(rows), np.int64), np.ones(n, np.int64), contexts)

    @classmethod
    def read(cls, data: bytes) -> Seating:
        delta, *rest, contexts = unpacked(data)
        return cls(np.cumsum(delta, dtype=np.uint64), *(x.astype(np.int64) for x in rest), np.cumsum(contexts, dtype=np.int64))

    def write(self) -> bytes:
        return packed(np.diff(self.hashes, prepend=np.uint64(0)), *(x.astype(np.uint32) for x in (self.each, self.singles, self.context, self.count, self.tables, self.roots)), np.diff(self.contexts, prepend=0).astype(np.uint32))

    def by_context(self) -> np.ndarray:
        """Tables of each of ``contexts``."""
        return np.bincount(self.context, self.tables, len(self.contexts)).astype(np.int64)

    def sums(self) -> list[int]:
        """Tables in the parent, tables in context restaurants, and of these in the start's but for rows of one customer."""
        own = self.by_context()
        return [int(self.roots.sum()), int(self.singles.sum() + own.sum()), int(own[self.contexts == 0].sum())]

    def customers(self) -> np.ndarray:
        """Customers of each word in the parent."""
        return self.singles + np.bincount(self.word, self.tables, len(self.each)).astype(np.int64)

    def sweep(self, whole: Whole, sweeps: range) -> None:
        """Draw half of the rows again in each of ``sweeps``, and at the end the words' tables in the parent; totals
        of other parts are those of the last exchange."""
        shown, shown_roots, new = self.tables.copy(), self.roots.copy(), (ROOT_STRENGTH + whole.d0 * whole.root_tables) * whole.base
        if self.grid is None:
            self.grid = Grid(self.count, whole.d)
        grid, nth = self.grid, np.cumsum(self.count > EXACT) - 1
        for s in sweeps:
            own = np.flatnonzero(chances(self.name, s, 0) < 0.5)
            count, word = self.count[own], self.word[own]
            others = self.customers()[word] - self.tables[own]
            kept = whole.d0 * np.minimum(self.roots[word], np.maximum(others, 1))
            weight = STRENGTH + whole.d * np.maximum(whole.tables[self.context[own]] - shown[own], 0)
            rest = ROOT_STRENGTH + np.maximum(whole.root_customers - shown[own], 0)
            self.tables[own] = draw(count, whole.d, weight, np.maximum(others - kept, 0) + new, others - kept + new, rest, chances(self.name[own], s, 1), grid[nth[own[count > EXACT]]])
        customers = self.customers()
        seen = np.flatnonzero(customers > 1)
        weight = ROOT_STRENGTH + whole.d0 * np.maximum(whole.root_tables - shown_roots[seen], 0)
        self.roots[customers == 1] = 1
        self.roots[seen] = draw(customers[seen], whole.d0, weight, np.full(len(seen), whole.base), None, None, chances(self.hashes[seen], sweeps[-1], 2), Grid(customers[seen], whole.d0))


_SEATED = "part int, chunk int, kind int, data binary, stats array<bigint>"
#: Kinds of rows: seatings, tables by context, rows of one customer by context, these summed up.
_STATE, _TABLES, _SINGLES, _FIXED = range(4)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    names = ("part", "chunk", "kind", "data", "stats")
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _dealt(part: int, kind: int, bounds: np.ndarray, contexts: np.ndarray, by_context: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of totals by context (numbers in order), one for each range of numbers that ``bounds`` tell."""
    cuts = np.searchsorted(contexts, bounds).tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield part, k, kind, packed(np.diff(contexts[a:b], prepend=bounds[k]).astype(np.uint32), *(x[a:b].astype(np.uint64) for x in by_context)), None


def start(pairs: DataFrame, offsets: np.ndarray, bounds: np.ndarray) -> DataFrame:
    """Each part's seating with one table a row; its tables and rows of one customer by context; and how many rows
    have one customer, two, words have one row, two, how many words are known, and seen once, tokens, texts, and
    rows of one customer of the start, then ``Seating.sums``."""

    def run(group: pa.Table) -> pa.Table:
        counts, part = Counts([x.as_py() for x in group["data"]]), group["part"][0].as_py()
        s = Seating.start(counts, 1 + int(offsets[part]))
        rows_of, single, begun = s.singles + s.each, counts.count == 1, counts.context == 0
        stats = [int(single.sum()), int((counts.count == 2).sum()), int((rows_of == 1).sum()), int((rows_of == 2).sum()), len(s.each), int((counts.total == 1).sum()), int(counts.count.sum()), int(counts.count[begun].sum()), int((single & begun).sum()), *s.sums()]
        contexts, singles = np.unique(counts.context[single], return_counts=True)
        return _table([(part, -1, _STATE, s.write(), stats), *_dealt(part, _TABLES, bounds, s.contexts, [s.by_context()]), *_dealt(part, _SINGLES, bounds, contexts, [singles])])

    return pairs.select("part", "data").groupBy("part").applyInArrow(run, _SEATED)


def fixed(seated: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Rows of one customer of each context, whose tables stay: a row for each range of numbers."""

    def run(group: pa.Table) -> pa.Table:
        k = group["chunk"][0].as_py()
        total = np.zeros(bounds[k + 1] - bounds[k], np.uint64)
        for data in group["data"]:
            delta, singles = unpacked(data.as_py())
            total[np.cumsum(delta, dtype=np.int64)] += singles
        return _table([(-1, k, _FIXED, packed(total), None)])

    return seated.filter(F.col("kind") == _SINGLES).select("chunk", "data").groupBy("chunk").applyInArrow(run, _SEATED)


def summed(seated: DataFrame, fixed: DataFrame, bounds: np.ndarray, firsts: np.ndarray | None = None, kinds: int = 1) -> DataFrame:
    """(part, chunk, kind, data): tables of all parts for the contexts that each part told of; or, with the parts' ``firsts``
    numbers, for each part those of its own words, ``kinds`` kinds."""

    def run(group: pa.Table) -> pa.Table:
        k, told, singles = group["chunk"][0].as_py(), [], np.zeros(1, np.uint64)
        for part, kind, data in zip(group["part"].to_pylist(), group["kind"].to_pylist(), group["data"]):
            if kind == _FIXED:
                singles = unpacked(data.as_py())[0]
            else:
                delta, *by_context = unpacked(data.as_py())
                told.append((part, np.cumsum(delta, dtype=np.int64), by_context))
        totals = [np.zeros(bounds[k + 1] - bounds[k], np.uint64) + singles for _ in range(kinds)]
        for _, at, by_context in told:
            for total, x in zip(totals, by_context):
                total[at] += x
        if firsts is None:
            return _table([(part, k, _TABLES, packed(*(t[at] for t in totals)), None) for part, at, _ in told])
        a = firsts - bounds[k]  # a part's words follow each other
        return _table([(p, k, _TABLES, packed(*(np.ascontiguousarray(t[a[p] : a[p + 1]]) for t in totals)), None) for p in range(len(firsts) - 1) if 0 <= a[p] < a[p + 1] <= len(totals[0])])

    rows = seated.filter(F.col("kind") == _TABLES).select("part", "chunk", "kind", "data").unionByName(fixed.select("part", "chunk", "kind", "data"))
    return rows.groupBy("chunk").applyInArrow(run, _SEATED).select("part", "chunk", "kind", "data")


def sums(seated: DataFrame) -> list[int]:
    """The sums of the parts' stats."""
    stats = seated.filter("stats is not null")
    n = stats.select(F.max(F.size("stats"))).first()[0] or 0
    return [x or 0 for x in stats.agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()] if n else []


def swept(seated: DataFrame, told: DataFrame, bounds: np.ndarray, parts: int, whole: Whole, sweeps: list[range]) -> DataFrame:
    """``seated`` after ``sweeps``, given tables by context ``told``, with its own after each range of them; the
    seating after each range is kept if there are several."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk")  # the seating first
        part, data = group["part"][0].as_py(), [x.as_py() for x in group["data"]]
        s, kept, by_context, stats = Seating.read(data[0]), [], [], []
        now = whole.of(np.concatenate([np.zeros(0, np.int64), *(unpacked(x)[0].astype(np.int64) for x in data[1:])]))
        for some in sweeps:
            s.sweep(now, some)
            kept += [s.tables.astype(np.uint32), s.roots.astype(np.uint32)]
            by_context.append(s.by_context())
            stats += s.sums()
        return _table([(part, -1, _STATE, s.write() if len(sweeps) == 1 else packed(*kept), stats), *_dealt(part, _TABLES, bounds, s.contexts, by_context)])

    few = max(partitions(seated.sparkSession), parts // PARTS_A_TASK)  # a part is little to read, and much to do
    rows = seated.filter(F.col("kind") == _STATE).select("part", "chunk", "kind", "data").unionByName(told)
    return rows.select("part", "chunk", "data").repartition(few, "part").groupBy("part").applyInArrow(run, _SEATED)


def estimated(one: int, two: int) -> float:
    """A discount from how many have one and two."""
    return min(0.95, max(0.05, one / max(1, one + 2 * two)))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    The model learns from the rows that aren't held out (crc32 of the id as text, null as empty, modulo 7
    is not 2). A null or blank text is the end token alone; repeated rows count and are scored each. Scores
    are log10 probabilities; perplexity is 10 ** (-score / n_tokens). Without training rows every word is
    unknown and certain to be so: score 0. Other columns are left out.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    bits = int(max(partitions(spark), size // PART_BYTES) - 1).bit_length()
    parts = 1 << bits
    made = stage_by(blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bits), "blocks", ["block"])
    texts = made.filter("part < 0").select("block", "doc_id", "held_out", "n_tokens", "data")
    ranks = stage(ranked(made.filter("part >= 0")), "ranks")
    sizes = np.zeros(parts, np.int64)
    for row in ranks.groupBy("part").agg(F.max("size").alias("size")).collect():  # as many as parts
        sizes[row["part"]] = row["size"]
    offsets = np.append(0, np.cumsum(sizes))
    bounds = 1 + offsets[:: max(1, min(PARTS_A_RANGE, parts // LEAST_RANGES))]  # of ranges of numbers
    bounds[0] = 0
    pairs = stage_by(counted(texts, ranks, offsets), "pairs", ["part"])
    unstage(ranks)
    seated = stage(start(pairs, offsets, bounds), "seated")
    one, two, word_one, word_two, words, hapaxes, n_tokens, n_texts, begun, *now = sums(seated) or [0] * 12
    d, d0 = estimated(one, two), estimated(word_one, word_two)
    single = stage(fixed(seated, bounds), "fixed")
    for r in range(ROUNDS):
        whole = Whole(d, d0, words, hapaxes, None, now[0], now[1])
        after = stage(swept(seated, summed(seated, single, bounds), bounds, parts, whole, [range(r * SWEEPS, (r + 1) * SWEEPS)]), "seated")
        unstage(seated)
        seated, now = after, sums(after) or now
    begin = ROUNDS * SWEEPS
    whole = Whole(d, d0, words, hapaxes, None, now[0], now[1])
    sampled = stage(swept(seated, summed(seated, single, bounds), bounds, parts, whole, [range(begin + k * APART, begin + (k + 1) * APART) for k in range(SAMPLES)]), "sampled")
    unstage(seated)
    now = sums(sampled) or [0] * (3 * SAMPLES)
    roots, tables, started = now[::3], now[1::3], [begun + x for x in now[2::3]]

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        c, of_context, state = Counts([x.as_py() for x in left["data"]]), [], None
        for chunk, data in zip(right["chunk"].to_pylist(), right["data"]):
            if chunk < 0:
                state = unpacked(data.as_py())
            else:
                of_context = [x[c.ranks] for x in unpacked(data.as_py())]
        of_context = of_context or [np.zeros(len(c.ranks), np.uint64)] * SAMPLES
        more, by_word = np.zeros(len(c.count), np.int64), [c.total]
        for k in range(SAMPLES):
            t, t0 = (c.count > 0).astype(np.int64), np.zeros(len(c.total), np.int64)
            t[c.count > 1], t0[c.total > 0] = state[2 * k], state[2 * k + 1]
            more += np.maximum(t - 1, 0)
            by_word += [np.bincount(c.word, t, len(c.total)), t0, of_context[k]]
        by_word = [x.astype(np.uint64) for x in by_word]
        at, data = 0, []
        for size, each in zip(c.sizes, c.each):
            own = c.inverse[at : at + size]
            word = c.word[own[np.cumsum(each, dtype=np.int64) - each]]
            data.append(packed(*(x[word] for x in by_word), c.count[own].astype(np.uint32), more[own].astype(np.uint32)))
            at += size
        return pa.table({"block": left["block"], "part": left["part"], "answer": pa.array(data, pa.binary())})

    state = sampled.filter(F.col("kind") == _STATE).select("part", "chunk", "kind", "data").unionByName(summed(sampled, single, bounds, 1 + offsets, SAMPLES)).select("part", "chunk", "data")
    answers = pairs.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(tell, "block bigint, part int, answer binary")
    floor = -np.log10(n_tokens + words + 1.0)
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        give_back()
        total, *by_word, count, more = (np.concatenate(x).astype(float) for x in zip(*(unpacked(x.as_py()) for x in right.sort_by("part")["answer"])))
        word, context, local, sizes = paired(left["data"])
        known = total > 0
        p = np.zeros(len(word))
        for k in range(SAMPLES):
            c0, t0, of_context = by_word[3 * k : 3 * k + 3]
            root = (c0 - d0 * t0 + (ROOT_STRENGTH + d0 * roots[k]) * np.where(known, whole.base, whole.unknown)) / (ROOT_STRENGTH + tables[k])
            p += (STRENGTH + d * np.append(started[k], of_context)[context]) * root[word]
        p = (count - d * ((count > 0) + more / SAMPLES) + p / SAMPLES) / (STRENGTH + np.append(n_texts, total)[context])
        starts = np.cumsum(sizes) - sizes
        score = np.add.reduceat(np.log10(p)[local], starts)
        base = np.add.reduceat((np.log10(total + 1.0) + floor)[word][local], starts)
        n_known = np.add.reduceat(known[word][local].astype(np.int64), starts)
        columns = [pa.array(n_known), pa.array(np.full(len(sizes), n_tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(300.0, -score / sizes))]
        return pa.Table.from_arrays([left["doc_id"], left["held_out"], left["n_tokens"], *columns], names=names)

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
