"""Packing into fixed windows by non-negative least squares over the histogram of lengths.

Documents are cut into whole windows and one remainder. Remainders are counted in bins of ``grain``
tokens; combinations of up to three bins that fill a window exactly are enumerated, their repeat counts
solved by non-negative least squares, rounded down within what there is, and the rest is packed greedily,
longest first with the best-fitting partners. The plan depends on the histogram alone (a bounded number of
bins), so its size does not grow with the data; pieces find their place by their rank in their bin.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bpe import Cached
from lattica.llm.common import spared, stage

GRAIN = 8


def combinations(bins: int) -> np.ndarray:
    """All multisets of two or three positive bins that sum to ``bins``, padded with 0, one a row."""
    pairs = [(a, bins - a, 0) for a in range(1, bins // 2 + 1)]
    triples = [(a, b, bins - a - b) for a in range(1, bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)]
    return np.array(pairs + triples, np.int64).reshape(-1, 3)


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|: the active-set method of Lawson and Hanson.

    ``rounds`` bounds the outer steps (three times the rows if None); the x so far is feasible at any step.
    """
    m, n = matrix.shape
    gram_target, x, free = matrix.T @ target, np.zeros(n), np.zeros(n, bool)
    residual = target.astype(float).copy()
    tolerance = 1e-9 * max(1.0, float(np.abs(gram_target).max(initial=0)))
    for _ in range(rounds or 3 * m):
        gain = np.where(free, -np.inf, matrix.T @ residual)
        best = int(gain.argmax()) if n else 0
        if not n or gain[best] <= tolerance:
            break
        free[best] = True
        while True:
            own = np.flatnonzero(free)
            part = matrix[:, own]
            trial = np.linalg.lstsq(part, target, rcond=None)[0] if len(own) >= m else np.linalg.solve(part.T @ part + 1e-12 * np.eye(len(own)), gram_target[own])
            if (trial > 0).all():
                x[:] = 0
                x[own] = trial
                break
            bad = trial <= 0
            step = np.min(x[own][bad] / np.maximum(x[own][bad] - trial[bad], 1e-300))
            x[own] = x[own] + step * (trial - x[own])
            drop = own[bad & (x[own] <= 1e-12)] if (bad & (x[own] <= 1e-12)).any() else own[bad][:1]
            x[drop], free[drop] = 0, False
            if not free.any():
                break
        residual = target - matrix[:, np.flatnonzero(free)] @ x[free]
    return x


def plan(histogram: np.ndarray, bins: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of bins and how often each is used, together exactly ``histogram`` (index: bin)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...], times: int) -> None:
        out.append((parts, times))
        for p in parts:
            left[p] -= times

    if left[bins]:
        use((bins,), int(left[bins]))
    some = combinations(bins)
    have = np.append(left > 0, False)
    have[0] = True
    some = some[have[some].all(axis=1)]
    if len(some):
        matrix = np.zeros((bins + 1, len(some)))
        for k in range(3):
            np.add.at(matrix, (some[:, k], np.arange(len(some))), 1)
        matrix[0] = 0
        times = np.floor(nnls(matrix, left.astype(float)) + 1e-6).astype(np.int64)
        for s in np.argsort(-times, kind="stable"):
            parts = tuple(int(p) for p in some[s] if p)
            n = min(int(times[s]), *(int(left[p]) // parts.count(p) for p in parts))
            if n > 0:
                use(parts, n)
    while left.any():  # the rest, longest first, each time with the longest that still fits
        parts = [int(np.flatnonzero(left)[-1])]
        taken = np.zeros_like(left)
        taken[parts[0]] += 1
        room = bins - parts[0]
        while room > 0 and len(fits := np.flatnonzero((left - taken)[: room + 1] > 0)):
            parts.append(int(fits[-1]))
            taken[parts[-1]] += 1
            room -= parts[-1]
        use(tuple(parts), int(min(left[p] // taken[p] for p in set(parts))))
    return out


def places(steps: list[tuple[tuple[int, ...], int]], bins: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bin: the first ranks of runs, ascending, each run's first sequence, and its slot there."""
    by_bin: dict[int, list] = {b: [] for b in range(bins + 1)}
    used, sequence = np.zeros(bins + 1, np.int64), 0
    for parts, times in steps:
        for slot, p in enumerate(parts):
            by_bin[p].append((used[p], sequence, slot))
            used[p] += times
        sequence += times
    return {b: tuple(np.array(c, np.int64) for c in zip(*runs)) for b, runs in by_bin.items() if runs}


_TOKENIZERS: dict = {}


def id_encoder(path: str) -> Cached:
    """Ids by a tokenizers file; kept in the worker.

    Byte-level tokenizers encode each pre-token on its own, so a text's ids are those of its slices.
    """
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            e = t.encode([w.decode("utf-8") for w in words], is_pretokenized=True, add_special_tokens=False)
            return np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(words))

        _TOKENIZERS[path] = Cached(encode)
    return _TOKENIZERS[path]


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, grain: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Pieces of all documents, with the partition that made each and its rank among that one's pieces of its bin."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _bin int, _part int, _rank bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = id_encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, ids_of = [], []
            for k, found in enumerate(encoder.ids([t or "" for t in batch.column(1).to_pylist()])):
                data = found.astype("<u4").tobytes() + end
                n = len(data) // 4
                for start in range(0, n, window):
                    piece = data[4 * start : 4 * (start + window)]
                    b = -(-len(piece) // (4 * grain))
                    rows.append((k, start, len(piece) // 4, zlib.crc32(piece), n, b, part, rank := seen.get(b, 0)))
                    seen[b] = rank + 1
                    if with_ids:
                        ids_of.append(np.frombuffer(piece, "<u4").astype(np.int32))
            at, *cols = map(np.array, zip(*rows))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()]
            arrays = [batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids_of, pa.list_(pa.int32()))] if with_ids else []), names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(spared(run), schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, grain: int = GRAIN,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text counts as empty and gives the end id alone; every id is in exactly one piece. Repeated rows
    are packed each on their own; an empty table gives an empty result; other columns are left out.
    ``window`` must be a multiple of ``grain``.
    """
    if window % grain:
        raise ValueError("window must be a multiple of grain")
    bins = window // grain
    pieces = stage(cut_documents(docs, tokenizer_path, window, end_id, grain, id_col, text_col, with_ids), "pieces")
    counts = pieces.groupBy("_bin", "_part").count()  # at most bins rows a partition
    before = Window.partitionBy("_bin").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bin", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    histogram = np.zeros(bins + 1, np.int64)
    for b, n in counts.groupBy("_bin").agg(F.sum("count")).collect():  # at most bins rows
        histogram[b] = n
    where = places(plan(histogram, bins), bins)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, rank = (np.asarray(batch.column(c)) for c in ("_bin", "_global"))
            sequence, slot = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for one in np.unique(b):
                own = np.flatnonzero(b == one)
                first, seq, pos = where[int(one)]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], slot[own] = seq[run] + rank[own] - first[run], pos[run]
            keep = [n for n in batch.schema.names if n not in ("_bin", "_global")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(slot)], names=[*keep, "sequence_id", "_slot"])

    ranked = pieces.join(starts, ["_bin", "_part"]).withColumn("_global", F.col("_before") + F.col("_rank")).drop("_before", "_rank", "_part")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("_bin", "_global")]
    placed = ranked.mapInArrow(assign, ", ".join([*kept, "sequence_id bigint", "_slot bigint"]))
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a window's few pieces
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("_slot")
