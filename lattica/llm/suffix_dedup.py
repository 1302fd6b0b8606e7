"""Removal of byte strings that occur elsewhere, by a logarithmic family of sampled suffix arrays.

Suffixes are sampled: in every window of ``length`` bytes the position whose next ANCHOR bytes hash
smallest is an anchor, so equal windows have their anchor at the same place. Each window reaches at least
half its length to one side of its anchor; an entry keys that side's bytes (ahead: a suffix of the text;
behind: a suffix of the reversed text), and stands for a run of windows, its coverage. A batch of documents
becomes arrays of entries ordered by key, one for each range of keys; in each range an array is
merge-scanned against the levels of the family, equal keys are long matches, and levels of one size merge
into the next, so that each key is rewritten a logarithmic number of times.

Matched entries are resolved exactly: where another entry has the same key and coverage, all its windows
occur twice; one of each such class, and the others, are split into parts of few windows, keyed by what a
part's windows have in common and matched the same way, and at last into single windows. Two strings count
as equal if a polynomial hash and XXH3, of 64 bits each, agree on all their bytes.

A batch sends each distinct (key, coverage) once, whatever its copies, and gets back one mark for each; rows
that move hold hashes, positions and marks. Texts of documents with matches are staged once, by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import packed, partitions, spared, stage, stage_by, unpacked, unstage

ANCHOR = 32
#: Entries of a batch (one text's are never parted), and bytes of text for each range of keys.
BATCH_ENTRIES, RANGE_BYTES = 200_000, 64 << 20
#: Bytes of text per vectorised step (one longer text is a step of its own), and rows of a list that may be broadcast.
STEP_BYTES = 1 << 19
BROADCAST_ROWS = 500_000
#: Windows that the parts of unresolved runs have, step by step; the last are single windows.
WIDTHS = (16, 1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BLANK = np.frombuffer(b" \t\n\r\v\f", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        have, top = 1, base
        while have < n:
            take = min(have, n - have)
            p[have : have + take] = p[:take] * np.uint64(top)
            top = top * top & _MASK
            have += take
        out.append(p)
    return tuple(out)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Spans:
    """Hashes of any spans of bytes, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, int(len(data)).bit_length())
        self.up, down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.up[start])

    def all(self, length: int) -> np.ndarray:
        """Of every span of ``length`` bytes, in order."""
        n = max(0, len(self.sums) - length)
        return _mix((self.sums[length:] - self.sums[:n]) * self.up[:n])


def window_runs(data: np.ndarray, ends: np.ndarray, length: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Entries of concatenated texts that end at ``ends``: text, key, first and last window, anchor, coverage.

    Windows are those inside one text, and ``allowed`` (by start) if that is given.
    """
    n = len(data) - length + 1
    if n <= 0:
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, no_hash, none, none, none, no_hash
    spans = Spans(data)
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    bits = int(len(data)).bit_length()
    order = (spans.all(ANCHOR) >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(data) - ANCHOR + 1, dtype=np.uint64)
    width, done, least = length - ANCHOR + 1, 1, order
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[:n], least[width - done : width - done + n])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    valid = np.arange(n) + length <= ends[text[:n]]
    if allowed is not None:
        valid &= allowed[:n]
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (text[1:n] != text[: n - 1])]
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], n) - 1
    lo, hi = lo[valid[lo]], hi[valid[lo]]
    at = anchor[lo]
    half = (length - ANCHOR) // 2  # windows that start up to this far before their anchor see the most ahead of it
    ahead = (np.maximum(lo, at - half + 1), hi, at, at + length - half + 1)
    behind = (lo, np.minimum(hi, at - half), at - half, at + ANCHOR)
    out = []
    for first, last, start, stop in (ahead, behind):
        own = first <= last
        first, last, start, stop, place = first[own], last[own], start[own], stop[own], at[own]
        out.append((text[first], spans.hash(start, stop), first, last, place, coverage(data, first, last, place, length)))
    return tuple(np.concatenate(c) for c in zip(*out))


def coverage(data: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all bytes of the windows from ``first`` to ``last``, and of their place about an anchor."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    plain = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64, len(first))
    return _mix(plain + _mix((last - first).astype(np.uint64) << np.uint64(32) | (place - first).astype(np.uint64)))


def _steps(texts: Iterator[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first, texts) of runs of about STEP_BYTES."""
    first, group, held, i = 0, [], 0, -1
    for i, t in enumerate(texts):
        group.append(t)
        held += len(t)
        if held >= STEP_BYTES:
            yield first, group
            first, group, held = i + 1, [], 0
    if group:
        yield first, group


_BATCHES = "batch bigint, part int, data binary"


class Batch:
    """Entries of whole documents."""

    def __init__(self, name: int, bits: int):
        """``bits``: key ranges are told by so many leading bits."""
        self.name, self.bits, self.held = name, bits, 0
        self.docs: list[np.ndarray] = []
        self.entries: list[tuple[np.ndarray, ...]] = []
        self.n_docs = 0

    def add(self, docs: np.ndarray, own: np.ndarray, key, lo, hi, at, whole) -> None:
        """``docs``: (d1, d2) a row; ``own``: each entry's row there; places are in the document's text."""
        self.docs.append(docs)
        self.entries.append((own + self.n_docs, key, lo, hi, at, whole))
        self.n_docs += len(docs)
        self.held += len(own)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each range of keys, with its distinct (key, coverage), and one (part -1) that stays: documents and entries."""
        if not self.held:
            return
        own, key, lo, hi, at, whole = (np.concatenate(c) for c in zip(*self.entries))
        order = np.lexsort((whole, key))
        own, key, lo, hi, at, whole = (c[order] for c in (own, key, lo, hi, at, whole))
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])])
        copies = np.diff(np.append(first, len(key)))
        key, whole = key[first], whole[first]
        part = (key >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(part)]
        parts, data = [-1], [packed(np.concatenate(self.docs).view(np.uint64).ravel(), copies.astype(np.uint32), own.astype(np.uint32), *(x.astype(np.int32).view(np.uint32) for x in (lo, hi - lo, at - lo)))]
        for a, b in zip(cuts, cuts[1:]):
            parts.append(int(part[a]))
            data.append(packed(np.diff(key[a:b], prepend=np.uint64(0)), whole[a:b], (copies[a:b] > 1).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([self.name] * len(parts), pa.int64()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["batch", "part", "data"])


def _batched(made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], bits: int):
    """A function for Arrow batches that puts what ``made`` gives, as for ``Batch.add``, into batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        batch = Batch(task << 32, bits)
        for found in made(batches):
            batch.add(*found)
            if batch.held >= BATCH_ENTRIES:
                yield from batch.rows()
                count += 1
                batch = Batch(task << 32 | count, bits)
        yield from batch.rows()

    return spared(run)


class Levels:
    """A family of sorted arrays of keys: at most one of each rank, a rank holding two of the rank below."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Take in a batch's sorted distinct keys and return those that some level has."""
        hits = [keys[:0]]
        for _, level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            hits.append(keys[level[at] == keys])
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            keys = np.union1d(keys, self.levels.pop()[1])
            rank += 1
        self.levels.append((rank, keys))
        return np.unique(np.concatenate(hits))


#: Marks of a (key, coverage): it occurs twice or more; it stands for its class, which must be split, as the key has others.
_TWICE, _LOOK = 1, 2


def judged(batches: list[bytes]) -> list[np.ndarray]:
    """For each batch's array of one range of keys, marks of its (key, coverage)."""
    family, hits = Levels(), []
    for data in batches:
        key, _, many = unpacked(data)
        key = np.cumsum(key, dtype=np.uint64)
        distinct = np.unique(key)
        hits += [family.add(distinct), key[many > 0], key[1:][key[1:] == key[:-1]]]
    matched = np.unique(np.concatenate(hits))
    rows, sizes = [], []
    for b, data in enumerate(batches):  # of matched keys alone
        key, whole, many = unpacked(data)
        key = np.cumsum(key, dtype=np.uint64)
        sizes.append(len(key))
        at = np.minimum(np.searchsorted(matched, key), len(matched) - 1)
        own = np.flatnonzero(matched[at] == key) if len(matched) else np.zeros(0, np.int64)
        rows.append((key[own], whole[own], 1 + many[own].astype(np.int64), np.full(len(own), b), own))
    key, whole, n, b, at = (np.concatenate(c) for c in zip(*rows))
    order = np.lexsort((whole, key))
    new_key = np.r_[True, key[order][1:] != key[order][:-1]]
    lead = new_key | np.r_[True, whole[order][1:] != whole[order][:-1]]
    group, of = np.cumsum(lead) - 1, np.cumsum(new_key) - 1
    marks = np.zeros(len(key), np.uint8)
    if len(key):
        copies, kinds = np.bincount(group, n[order]), np.bincount(of, lead)
        marks[order] = (copies[group] > 1) * _TWICE + ((kinds[of] > 1) & lead) * _LOOK
    out = [np.zeros(size, np.uint8) for size in sizes]
    for i in range(len(batches)):
        out[i][at[b == i]] = marks[b == i]
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts as few as cover the same."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    most = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] > most[:-1] + 1]) if len(lo) else np.zeros(0, np.int64)
    return lo[first], most[np.append(first[1:], len(lo)) - 1] if len(lo) else hi


def _runs(lists: list[bytes] | None, width: int = 2) -> np.ndarray:
    """The numbers of lists of runs, ``width`` a row."""
    return np.concatenate([np.frombuffer(x, "<i4") for x in lists]).reshape(-1, width).astype(np.int64) if lists else np.zeros((0, width), np.int64)


_FOUND = "d1 bigint, d2 bigint, sure binary, look binary"


def matches(batches: DataFrame, name: str, join: bool = True) -> DataFrame:
    """(d1, d2, sure, look) staged, for documents with any: runs (lo, hi) of windows that occur again, as few as
    can be with ``join``, and runs (lo, hi, at) to split further."""
    made = stage(batches, f"{name}-batches")

    def mark(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        marks = judged([x.as_py() for x in group["data"]])
        return pa.table({"batch": group["batch"], "part": group["part"], "marks": pa.array([packed(m) for m in marks], pa.binary())})

    def deal(held: pa.Table, marked: pa.Table) -> pa.Table:
        docs, copies, own, lo, hi, at = unpacked(held["data"][0].as_py())
        docs, (lo, hi, at) = docs.reshape(-1, 2).view(np.int64), (x.view(np.int32).astype(np.int64) for x in (lo, hi, at))
        marks = np.concatenate([unpacked(x.as_py())[0] for x in marked.sort_by("part")["marks"]])
        first = np.cumsum(copies) - copies
        which = np.repeat(np.arange(len(copies)), copies)
        sure = np.flatnonzero(marks[which] & _TWICE)
        look = first[(marks & _LOOK) > 0]
        lists: dict[int, list] = {}
        for slot, rows in enumerate((sure, look)):
            rows = rows[np.argsort(own[rows], kind="stable")]
            mine, start = np.unique(own[rows], return_index=True)
            for d, r in zip(mine.tolist(), np.split(rows, start[1:])):
                a, b = lo[r], lo[r] + hi[r]
                if slot:
                    held_runs = np.stack([a, b, a + at[r]], axis=1)
                else:
                    held_runs = np.stack(merged(a, b) if join else (a, b), axis=1)
                lists.setdefault(d, [None, None])[slot] = held_runs.astype("<i4").tobytes()
        at = list(lists)
        return pa.table({"d1": pa.array(docs[at, 0], pa.int64()), "d2": pa.array(docs[at, 1], pa.int64()), "sure": pa.array([v[0] for v in lists.values()], pa.binary()), "look": pa.array([v[1] for v in lists.values()], pa.binary())})

    marks = made.filter("part >= 0").groupBy("part").applyInArrow(mark, "batch bigint, part int, marks binary")
    found = made.filter("part < 0").groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(deal, _FOUND)
    out = stage(found, name)
    unstage(made)
    return out


def _texts(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in column)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))], axis=1)


def entries(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Batches of the entries of ``docs`` (d1, d2, text; runs: of these windows alone)."""
    within = "runs" in docs.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, lists = _ids(batch), batch.column(3).to_pylist() if within else []
            for first, texts in _steps(_texts(batch.column(2))):
                ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
                data, base, allowed = np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends), None
                if within:
                    edge = np.zeros(len(data) + 2, np.int64)
                    for k in range(len(texts)):
                        for lo, hi in _runs(lists[first + k]).tolist():
                            edge[base[k] + lo] += 1
                            edge[base[k] + hi + 1] -= 1
                    allowed = np.cumsum(edge) > 0
                text, key, lo, hi, at, whole = window_runs(data, ends, length, allowed)
                yield ids[first : first + len(texts)], text, key, lo - base[text], hi - base[text], at - base[text], whole

    return docs.select("d1", "d2", "text", *(["runs"] if within else [])).mapInArrow(_batched(made, bits), _BATCHES)


def parts_of(docs: DataFrame, length: int, width: int, bits: int) -> DataFrame:
    """Batches of parts of the ``look`` runs of ``docs`` (d1, d2, text, look), each of up to ``width`` windows by
    distance to their anchor.

    A part's key is what all its windows have in common, so that equal windows lie in parts of equal keys.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = _ids(batch)
            for k, (data, runs) in enumerate(zip(_texts(batch.column(2)), batch.column(3))):
                data = np.frombuffer(data, np.uint8)
                spans, runs = Spans(data), _runs(runs.as_py(), 3)
                for a in range(0, len(runs), 4096):
                    l, h, c = runs[a : a + 4096].T
                    least, most = (c - h) // width, (c - l) // width
                    n = most - least + 1
                    own = np.repeat(np.arange(len(n)), n)
                    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + least[own]
                    place = c[own] - j * width
                    first, last = np.maximum(l[own], place - width + 1), np.minimum(h[own], place)
                    key = _mix(spans.hash(place, place - width + 1 + length) + _mix(j.astype(np.uint64)))
                    yield ids[k : k + 1], np.zeros(len(own), np.int64), key, first, last, c[own], coverage(data, first, last, c[own], length)

    return docs.select("d1", "d2", "text", "look").mapInArrow(_batched(made, bits), _BATCHES)


def short_strings(docs: DataFrame, words: int, length: int, bits: int) -> DataFrame:
    """Batches of the strings of ``words`` words in under ``length`` bytes of ``docs`` (d1, d2, text), as runs that
    cover them (of starts from lo up to hi, which can lie before lo)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = _ids(batch)
            for k, data in enumerate(_texts(batch.column(2))):
                start, stop = word_places(data)
                n = max(0, len(start) - words + 1)
                lo, end = start[:n], stop[words - 1 :][:n]
                few = end - lo < length
                lo, end = lo[few], end[few]
                if len(lo):
                    key, whole = (np.fromiter((f(data[a:b]) for a, b in zip(lo.tolist(), end.tolist())), np.uint64, len(lo)) for f in (xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest))
                    yield ids[k : k + 1], np.zeros(len(lo), np.int64), key, lo, end - length, lo, whole

    return docs.select("d1", "d2", "text").mapInArrow(_batched(made, bits), _BATCHES)


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop."""
    blank = np.concatenate([[True], np.isin(np.frombuffer(data, np.uint8), _BLANK), [True]])
    return np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])


def _lists(found: DataFrame, column: str, name: str) -> DataFrame:
    """(d1, d2, ``name``): one row a document, with all its lists."""
    return found.filter(F.col(column).isNotNull()).groupBy("d1", "d2").agg(F.collect_list(column).alias(name))


def resolved(texts: DataFrame, first: DataFrame, length: int, bits: int) -> DataFrame:
    """(d1, d2, runs): for documents with any, lists of runs of starts of windows that start elsewhere too, from
    the matched entries ``first``; ``texts`` (d1, d2, text) has all documents of that."""
    levels, used = [first], []
    for width in WIDTHS:
        look = texts.join(_lists(levels[-1], "look", "look"), ["d1", "d2"])
        levels.append(matches(parts_of(look, length, width, bits), f"parts{width}"))
        used.append(levels[-1])
    sure = levels[0].select("d1", "d2", "sure")
    for level in levels[1:]:
        sure = sure.unionByName(level.select("d1", "d2", "sure"))
    out = stage(_lists(sure, "sure", "runs"), "runs")
    unstage(*used)
    return out


def starts_of_longer(lists: list[bytes], shorter: int, length: int) -> bytes:
    """Where windows of ``length`` bytes can repeat, from the runs of ``shorter`` ones that do."""
    lo, hi = merged(*_runs(lists).T)
    hi = hi - (length - shorter)
    return np.stack([lo, hi], axis=1)[lo <= hi].astype("<i4").tobytes()


def covered(n: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a window that starts in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + length, -1)
    return np.cumsum(edge[:n]) > 0


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", repair: bool = False, words: int = 0, passage: tuple[int, int] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with the text less its repeated bytes, and n_bytes, n_removed,
    n_spans and kept_sha256 (of the remaining bytes).

    A byte goes if a ``length``-byte string that covers it also starts anywhere else in the input, in the
    same text or another; strings are judged on the input. With ``words``, so do shorter strings of that many
    words (what lies between spaces, tabs and line ends). With ``passage`` (bytes, at most ``length``, and
    words) n_passage is added: of the runs of bytes that such strings cover, those of that many words, in
    bytes; these are reported, not removed. The family is then built for the shorter strings, and what is
    longer is looked for where they repeat.

    Null texts count as empty and stay null; other texts shorter than ``length`` stay whole; a repeated row is
    a document of its own, so that both lose what they share. A cut can split a character: the text column
    then has the replacement character, or with ``repair`` whole characters only; kept_sha256 is of the exact
    bytes. Input columns named like an added one are replaced; an empty table gives an empty result.
    """
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"} | ({"n_passage": "bigint"} if passage else {})
    docs = docs.drop(*added)
    spark = docs.sparkSession
    base, many = passage or (length, words)
    if base > length:
        raise ValueError("a passage must not have more bytes than what is removed")
    names = [c for c in docs.columns if c != text_col]
    plain = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in names if c.lower() not in ("d1", "d2", "runs")]
    id_hash: Column = F.xxhash64(*others) if others else F.lit(0).cast("long")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), plain.alias("text"), F.xxhash64(plain, id_hash).alias("d1"), F.xxhash64(id_hash, F.lit(7), F.xxhash64(plain)).alias("d2"))
    ranges = max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0) // RANGE_BYTES))
    bits = int(ranges - 1).bit_length()
    first = matches(entries(keyed, base, bits), "entries")
    short = matches(short_strings(keyed, many, base, bits), "short", join=False) if many else None
    seen = first.select("d1", "d2") if short is None else first.select("d1", "d2").unionByName(short.select("d1", "d2"))
    seen = stage(seen.distinct(), "seen")
    few = seen.count() <= BROADCAST_ROWS
    met = keyed.select("row", "d1", "d2").join(F.broadcast(seen) if few else seen, ["d1", "d2"], "left_semi")
    met = stage_by(met, "met", ["d1", "d2"])  # later joins by document move lists alone
    texts = met.select("d1", "d2", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
    based = runs = resolved(texts, first, base, bits)
    if base < length:
        longer = F.udf(lambda lists: [starts_of_longer(lists, base, length)], "array<binary>", useArrow=True)
        inside = stage(based.select("d1", "d2", longer("runs").alias("runs")).filter(F.octet_length(F.col("runs")[0]) > 0), "inside")
        runs = resolved(texts, matches(entries(texts.join(inside, ["d1", "d2"]), length, bits), "longer"), length, bits)
    lists = met.join(runs, ["d1", "d2"], "left")
    lists = lists.join(based.withColumnRenamed("runs", "based"), ["d1", "d2"], "left") if base < length else lists.withColumn("based", F.col("runs"))
    lists = lists.join(_lists(short, "sure", "short"), ["d1", "d2"], "left") if short is not None else lists.withColumn("short", F.lit(None).cast("array<binary>"))
    fields = ", ".join(["text string", *(f"{k} {v}" for k, v in added.items())])
    row_type = keyed.schema["row"].dataType.simpleString()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[tuple] = []
            for data, own, shorter, strings in zip(_texts(batch.column(1)), *(batch.column(c) for c in (2, 3, 4))):
                view = np.frombuffer(data, np.uint8)
                gone = covered(len(view), *_runs(own.as_py()).T, length)
                in_short = covered(len(view), *_runs(strings.as_py()).T, base)
                if words:
                    gone |= in_short
                kept = view[~gone].tobytes()
                row = [kept.decode("utf-8", "ignore" if repair else "replace"), len(view), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(kept).hexdigest()]
                if passage:
                    a, b = _spans(in_short | covered(len(view), *_runs(shorter.as_py()).T, base))
                    start, stop = word_places(data)
                    enough = np.searchsorted(stop, b, "right") - np.searchsorted(start, a) >= many
                    row.append(int((b - a)[enough].sum()))
                out.append(row)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["row", "text", *added])

    text = F.coalesce(F.col("row")[text_col], F.lit("")).alias("text")
    done = lists.select("row", text, "runs", "based", "short").mapInArrow(spared(cut), f"row {row_type}, {fields}")
    none = F.lit(0).cast("long")
    rest = keyed.join(F.broadcast(seen) if few else seen, ["d1", "d2"], "left_anti")
    rest = rest.select("row", "text", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), *([none.alias("n_passage")] if passage else []))
    both = done.unionByName(rest)
    body = F.when(F.col("row")[text_col].isNotNull(), F.col("text"))
    return both.select(*(body.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), *added)
