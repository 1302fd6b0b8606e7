"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

The filter is blocked: a text's hash gives it one block of 32,768 positions and two positions there. Pass one
counts how often each position is set and keeps, as a bitmap a block, those set twice or more. Pass two
probes each row: a row one of whose positions was set once cannot have an equal text elsewhere and passes
straight through. Only the rest are staged and meet by their SHA-256.

A probe broadcasts bitmaps of a bounded size. Where all blocks are more than that, they are dealt to
segments, rows are staged by segment (each task writes its own rows; nothing shuffles), and each segment's
rows are probed against that segment's bitmaps alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fresh, stage

#: Positions of the filter for each row; at 16, and two set a row, about one unique row in 70 is staged in vain.
BITS_PER_ROW = 16
#: Positions of a block, and its bytes in a broadcast hash table (bitmap, key and header).
BLOCK_BITS, BLOCK_BYTES = 1 << 15, 4096 + 64
#: Bytes of bitmaps that a probe may broadcast.
BROADCAST_BYTES = 64 << 20


def _places(text: Column, blocks: int) -> tuple[Column, Column, Column]:
    """A text's block and its two positions there."""
    first = F.xxhash64(text)
    second = F.xxhash64(first, F.lit(1))
    inside = lambda h: h.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    return F.pmod(first, F.lit(blocks)), inside(second), inside(F.shiftrightunsigned(second, 15))


def repeated_filter(text_rows: DataFrame, text: Column, blocks: int) -> DataFrame:
    """(block, bits) of the second filter: bitmaps of the positions that are set twice or more."""
    block, one, two = _places(text, blocks)
    set_by = text_rows.select(block.alias("block"), F.explode(F.array(one, two)).alias("p"))
    twice = set_by.groupBy("block", "p").count().filter("count > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("p").cast("long")).alias("bits"))


def _is_set(bits: str, p: str) -> str:
    """Whether a bitmap has a position: its byte's digits are read as a number."""
    byte = f"cast(conv(hex(substring(`{bits}`, shiftright(`{p}`, 3) + 1, 1)), 16, 10) as int)"
    return f"coalesce(shiftright({byte}, `{p}` & 7) & 1, 0) = 1"


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None,
    bits_per_row: int = BITS_PER_ROW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size, kept and text_sha256.

    Of rows with equal text (null counts as empty; ``normalise`` may map the text column first) the
    largest ``id_col`` stays; null ids come last, and of rows equal in both exactly one is kept. Input
    columns named like an added one are replaced. An empty table gives an empty result.

    Only possibly repeated rows shuffle, at any size: where the bitmaps are more than ``broadcast_bytes``,
    rows are written once by segment and once after the probe instead.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    text = F.coalesce(docs[text_col], F.lit(""))
    text = normalise(text) if normalise else text
    blocks = max(1, math.ceil(docs.count() * bits_per_row / BLOCK_BITS))
    segments = math.ceil(blocks * BLOCK_BYTES / broadcast_bytes)
    bloom = stage(repeated_filter(docs, text, blocks), "bloom")
    block, one, two, bits, key, hit, segment, uid, best, size = fresh(docs, "block", "one", "two", "bits", "key", "hit", "segment", "uid", "best", "size")

    def probed(rows: DataFrame, part: DataFrame) -> DataFrame:
        side = F.broadcast(part.select(F.col("block").alias(key), F.col("bits").alias(bits)))  # at most broadcast_bytes
        rows = rows.join(side, F.col(block) == F.col(key), "left")
        return rows.withColumn(hit, F.expr(f"{_is_set(bits, one)} and {_is_set(bits, two)}")).drop(key, bits, block, one, two)

    rows = docs.withColumn("text_sha256", F.sha2(text.cast("binary"), 256)).withColumns(dict(zip((block, one, two), _places(text, blocks))))
    if segments <= 1:
        rows = probed(rows, bloom)
    else:
        dealt = stage(rows.withColumn(segment, F.pmod(F.col(block), F.lit(segments)).cast("int")), "segments", by=segment)
        done = None
        for s in range(segments):
            part = probed(dealt.filter(F.col(segment) == s).drop(segment), bloom.filter(F.pmod("block", F.lit(segments)) == s))
            part = stage(part, "probed")
            done = part if done is None else done.unionByName(part)
        rows = done
    alone = rows.filter(~F.col(hit)).drop(hit).withColumns({"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    maybe = stage(rows.filter(F.col(hit)).drop(hit).withColumn(uid, F.monotonically_increasing_id()), "maybe")
    groups = stage(maybe.groupBy("text_sha256").agg(F.max(F.struct(id_col, uid)).alias(best), F.count("*").alias(size)), "groups")
    decided = maybe.join(groups, "text_sha256").withColumns(  # groups are staged, so that Spark can split the rows of a hot one
        {"keep_id": F.col(best)[id_col], "group_size": F.col(size), "kept": F.col(uid) == F.col(best)[uid]}
    ).drop(uid, best, size)
    return decided.select(*docs.columns, "keep_id", "group_size", "kept", "text_sha256").unionByName(alone)
