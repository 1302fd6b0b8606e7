"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds modular prefix arrays of one text: any span's hash takes two look-ups, so span equality
is a comparison and the longest common extension a binary search. A fingerprint holds the hash of the
whole text and a sketch of its spans of SPAN code points: one smallest span hash for each of SLOTS
classes of span hashes. The share of spans that two texts have in common is estimated from the sketches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import partitions, spared, stage

PRIME = (1 << 31) - 1
BASES = (1_000_003, 1_664_525)
SPAN, SLOTS = 16, 64
_EMPTY = 0xFFFF
_ALL = np.uint64(0xFFFFFFFF)
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(31))
    x = (x & _P) + (x >> np.uint64(31))
    return np.minimum(x, x - _P)  # the lesser of the two is below the prime, as the difference wraps


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` in place, a product of two numbers below the prime: congruent to it and below twice the prime."""
    high = x >> np.uint64(31)
    x &= _P
    x += high
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    x = _folded(a * b)
    return np.minimum(x, x - _P, out=x)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences modulo the prime of numbers below it."""
    x = a - b
    return np.minimum(x, x + _P, out=x)  # a negative one wraps, and adding the prime wraps it back


class _Powers:
    """Powers of the bases and of their inverses, grown to the longest text seen."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = 1 << int(n).bit_length()
        self.up, self.down = ([self._all(b) for b in bases] for bases in (BASES, [pow(b, -1, PRIME) for b in BASES]))

    def _all(self, base: int) -> np.ndarray:
        p, have, top = np.ones(self.size, np.uint64), 1, base
        while have < self.size:
            take = min(have, self.size - have)
            p[have : have + take] = _times(p[:take], np.uint64(top))
            top = top * top % PRIME
            have += take
        return p


_POWERS = _Powers()


class Prefix:
    """Prefix arrays of one text; positions are code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        _POWERS.grow(self.n + 1)
        self.sums = []
        for up in _POWERS.up:
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_folded(points * up[: self.n]), out=sums[1:])  # below 2^32 each: exact for 2^32 code points
            self.sums.append(_mod(sums))

    def hash(self, start, stop) -> np.ndarray:
        """62-bit hashes of spans [start, stop), alone or arrays of them."""
        start, stop = np.atleast_1d(start), np.atleast_1d(stop)
        a, b = (_times(_minus(s[stop], s[start]), down[start]) for s, down in zip(self.sums, _POWERS.down))
        return a << np.uint64(31) | b

    def one(self, start: int, stop: int) -> int:
        """``hash`` of a single span, without arrays."""
        a, b = ((s.item(stop) - s.item(start)) * down.item(start) % PRIME for s, down in zip(self.sums, _POWERS.down))
        return a << 31 | b

    def equal(self, start: int, other: Prefix, at: int, length: int) -> bool:
        """Whether two spans of ``length`` are equal."""
        if length < 0 or start + length > self.n or at + length > other.n:
            return False
        return self.one(start, start + length) == other.one(at, at + length)

    def extension(self, start: int, other: Prefix, at: int) -> int:
        """How many code points from ``start`` here and ``at`` there agree: by doubled lengths up to one
        that does not, as most texts part early, and a binary search below it."""
        least, most, length = 0, min(self.n - start, other.n - at), 1
        while length <= most and self.equal(start, other, at, length):
            least, length = length, 2 * length
        most = min(most, length - 1)
        while least < most:
            middle = (least + most + 1) // 2
            least, most = (middle, most) if self.equal(start, other, at, middle) else (least, middle - 1)
        return least

    def spans(self) -> np.ndarray:
        """Mixed hashes of all spans of SPAN code points, in order; of the whole text if it is shorter."""
        if not self.n:
            return np.zeros(0, np.uint64)
        span = min(SPAN, self.n)
        m = self.n - span + 1
        a, b = (_times(_minus(s[span:], s[:m]), down[:m]) for s, down in zip(self.sums, _POWERS.down))
        return _mixed(a << np.uint64(31) | b)

    def joined(self, own: int, other: Prefix, theirs: int) -> int:
        """The hash of this text's first ``own`` code points followed by the other's first ``theirs``."""
        _POWERS.grow(own + 1)
        a, b = ((mine.item(own) + their.item(theirs) * up.item(own)) % PRIME for mine, their, up in zip(self.sums, other.sums, _POWERS.up))
        return a << 31 | b


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def sketch(spans: np.ndarray) -> np.ndarray:
    """For each class of span hashes the last 16 bits of the smallest one, _EMPTY where there is none."""
    out = np.full(SLOTS, _EMPTY, np.uint64)
    few = spans[spans >> np.uint64(32) < np.uint64(min(1 << 32, (12 * SLOTS << 32) // max(1, len(spans))))]  # the least of each class, nearly always
    for some in (few, spans):
        slot = some & np.uint64(SLOTS - 1)
        key = np.sort(slot << np.uint64(32) | some >> np.uint64(32))
        slot = (key >> np.uint64(32)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(slot[1:] != slot[:-1]) + 1]) if len(slot) else np.zeros(0, int)
        out[slot[first]] = np.minimum(key[first] & np.uint64(0xFFFF), np.uint64(_EMPTY - 1))
        if len(first) == SLOTS:
            break
    return out


def fingerprint(whole: int, n: int, spans: np.ndarray) -> str:
    """Hex: the whole text's hash (16 digits), its length (16), and the sketch (4 for each slot)."""
    return f"{whole:016x}{n:016x}" + sketch(spans).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The estimated share of spans two fingerprinted texts have in common (Dice), 0 to 1; 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[32:]), ">u2") for f in (a, b))
    used = (x != _EMPTY) | (y != _EMPTY)
    if not used.any():
        return 0.0
    same = float(np.count_nonzero((x == y) & used)) / float(np.count_nonzero(used))
    return 2 * same / (1 + same)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited bigint, common_next bigint"


class _Read:
    """A text with its prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str):
        self.text, self.prefix = text, Prefix(text)
        self.spans = self.prefix.spans()
        self.mark = fingerprint(self.prefix.one(0, self.prefix.n), self.prefix.n, self.spans)


def _compare(own: _Read, then: _Read) -> tuple:
    """What is returned for a text and the next: the edited text's hashes come from the arrays of the two."""
    changed = edited(own.text, then.text)
    n, half = own.prefix.n, own.prefix.n // 2
    kept, taken = n - half, min(half, then.prefix.n)
    whole = own.prefix.joined(kept, then.prefix, taken)
    if kept < SPAN or taken < SPAN:
        spans = Prefix(changed).spans()
    else:  # spans inside either part, and those across the seam
        spans = np.concatenate([own.spans[: kept - SPAN + 1], then.spans[: taken - SPAN + 1], Prefix(changed[kept - SPAN + 1 : kept + SPAN - 1]).spans()])
    mark = fingerprint(whole, kept + taken, spans)
    same = kept + min(own.prefix.extension(kept, then.prefix, 0), taken)
    return (n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.mark, mark, likeness(own.mark, mark), likeness(own.mark, then.mark), same, own.prefix.extension(0, then.prefix, 0))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text, their likeness, the likeness to the next
    document's fingerprint, and the longest common starts (common_edited, common_next) in code points.

    The next document is the one that follows in descending order of id (null ids last; rows of one id in
    an order fixed for the run), and the first after the last. A null text counts as empty; two empty texts
    are alike, an empty one and another are not. A single row follows itself. Other columns are left out.

    Texts shuffle once, by range of id. Neighbours meet within a partition; only a partition's first and
    last rows, staged with their texts, meet across partitions.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))]
    schema = f"doc_id {kind}, {_FIELDS}, part int, edge string, text string"
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    own_kinds = [kinds[f.split()[1]] for f in schema.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids = TaskContext.get().partitionId(), None, None
        for batch in batches:
            ids, rows, place = batch.column(0), [], []
            for k, t in enumerate(batch.column(1)):
                now = (ids.slice(k, 1), _Read(t.as_py() or ""))
                if before is None:
                    place.append(now[0]), rows.append((*[None] * 8, part, "first", now[1].text))
                else:
                    place.append(before[0]), rows.append((*_compare(before[1], now[1]), part, None, None))
                before = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(place), *(pa.array(c, k) for c, k in zip(zip(*rows), own_kinds))], names=[*names, "part", "edge", "text"])
        if before is not None:
            row = (*[None] * 8, part, "last", before[1].text)
            yield pa.RecordBatch.from_arrays([before[0], *(pa.array([c], k) for c, k in zip(row, own_kinds))], names=[*names, "part", "edge", "text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compare(_Read(a), _Read(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), own_kinds))], names=names)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = chosen.repartitionByRange(partitions(spark), order).sortWithinPartitions(order)
    made = stage(dealt.mapInArrow(spared(run), schema), "prefix")
    first, last = (made.filter(F.col("edge") == e).select("doc_id", "part", "text") for e in ("first", "last"))
    following = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)  # over one row a partition, without texts
    links = first.select("part").withColumn("then", F.min("part").over(following))
    links = links.withColumn("then", F.coalesce("then", F.min("part").over(Window.partitionBy())))
    ends = last.join(links, "part").join(first.select(F.col("part").alias("then"), F.col("text").alias("next")), "then")
    closed = ends.select("doc_id", "text", "next").mapInArrow(close, f"doc_id {kind}, {_FIELDS}")
    return made.filter("edge is null").select(*names).unionByName(closed)
