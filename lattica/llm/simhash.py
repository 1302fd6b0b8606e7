"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two fingerprints of B bytes that differ in at most t bits differ in at most t bytes, so they share at
least B - t positional bytes. Blocks of adjacent positions are indexed so that any such pair meets under
a key; each pair's shared positional bytes are tallied, pairs below the guaranteed minimum dropped, and
the rest verified bit by bit. Keys that many fingerprints share are not paired: each of their
fingerprints is listed under every value at one bit's distance instead, where two fingerprints meet
exactly if they differ in at most two bits, in groups of 65 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import spared, stage

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingle hashes unpacked to bits at a time.
CHUNK = 1 << 17
#: Fingerprints under one key up to which they are paired.
PAIRED = 16


def shingle_hashes(text: str, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of all if there are fewer; none without words."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found], dtype=np.int64) - 1 if found else np.zeros(0, np.int64)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)] if found else []
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())]


def simhash(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints: a bit is 1 if set in over half of the hashes; 0 without hashes."""
    counts = np.zeros((len(hashes), 64), np.int64)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for one in hashes for h in one), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for i in range(0, len(flat), CHUNK):
        bits = np.unpackbits(flat[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + CHUNK]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel()


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", name: str = "fp") -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the fingerprint as a bigint ``name``."""
    keep = [c for c in docs.columns if c != text_col and c.lower() != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), f"{name} bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, group, held = batch.column(len(keep)), [], [], 0
            for t in texts:
                group.append(shingle_hashes(t.as_py() or "", words))
                held += len(group[-1])
                if held >= CHUNK:
                    out.append(simhash(group))
                    group, held = [], 0
            out.append(simhash(group))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(out), pa.int64())], names=[*keep, name])

    return docs.select(*keep, text_col).mapInArrow(spared(run), schema)


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two bigints share."""
    x = a.bitwiseXOR(b)
    return sum(((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))) == 0).cast("int") for i in range(8))


def links(prints: DataFrame, bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b), a < b, that connect all of the distinct bigints ``prints.fp`` at ``bits`` (0 to 2) bits or fewer.

    Every pair under keys of few fingerprints is there; fingerprints of crowded keys are connected by
    stars, which leave the connected components the same.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    blocks = [0xFFFF << (16 * i) for i in range(4)]  # two bytes each; two of four are free of any two bits
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))
    index = prints.select("fp", F.explode(keys).alias("e")).select("fp", "e.c", "e.k")
    sizes = index.groupBy("c", "k").count().filter("count > 1")
    met = stage(index.join(sizes, ["c", "k"]), "met")
    few = met.filter(F.col("count") <= paired).groupBy("c", "k").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    pairs = few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    a, b = F.col("a"), F.col("b")
    pairs = pairs.filter(shared_bytes(a, b) >= 8 - bits).filter(F.bit_count(a.bitwiseXOR(b)) <= bits).distinct()
    crowd = met.filter(F.col("count") > paired).select("fp").distinct()
    near = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64))))
    if bits == 2:
        at = crowd.select("fp", near.alias("v")).groupBy("v").agg(F.array_sort(F.collect_set("fp")).alias("m")).filter("size(m) > 1")  # 65 at most
        stars = at.select(F.col("m")[0].alias("a"), F.explode(F.expr("slice(m, 2, size(m))")).alias("b")).distinct()
    else:
        at = crowd.select("fp", near.alias("b")).filter("b > fp").join(crowd.withColumnRenamed("fp", "b"), "b")
        stars = at.select(F.col("fp").alias("a"), "b").filter(F.lit(bits == 1))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Large stars and small stars alternate until the edges no longer change; each round's edges are
    written to the shared folder, so lineage and recovery stay short.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage(small.distinct(), "edges")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: its id, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in ``bits`` bits or fewer are linked; component_id is the smallest
    id reachable. Null, empty and blank texts have fingerprint 0 and are linked like any other; repeated
    rows stay repeated; an empty table gives an empty result; other columns are left out. Links are found
    between distinct fingerprints, so copies cost nothing beyond their own row.
    """
    marked = stage(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words), "prints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = components(links(distinct.select("fp"), bits))
    member = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = stage(member, "members")
    best = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(best, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
