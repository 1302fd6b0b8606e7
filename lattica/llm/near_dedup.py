"""Near-duplicate documents: texts whose sets of word shingles have a given Jaccard similarity, found exactly.

Shingles have one order, rare ones first. Two similar sets share a shingle among the first n - ceil(s * n) + 1
of each (prefix filter), so those are indexed, and pairs that meet are verified on their whole sets. Only
connected texts matter: a key shared by many texts links each with its neighbours in order and with the
first, where verified; members not yet connected by that are compared all with all, in blocks.

On request the links of the operator's first form, between fingerprints, count as well: they see repeats of
shingles, which sets do not, and sets see likeness far beyond a few bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import spared, stage, unstage
from lattica.llm.simhash import components, fingerprints, links, shingle_hashes

#: Texts under one key up to which they are paired at once.
PAIRED = 16
#: One text of so many tells which shingles are common, if in COMMON_TEXTS of these at least; COMMON at most. This sets the order alone.
SAMPLED, COMMON_TEXTS, COMMON = 8, 2, 1_000_000
#: Shingles of a block of a crowded key's texts, of which each counts as TEXT_COST more, and shingles counted at a time.
BLOCK_SHINGLES, TEXT_COST, STEP = 1 << 17, 256, 1 << 13
#: Texts whose ids may be broadcast to pick them out.
BROADCAST_ROWS = 500_000
#: Allowance for rounding where a similarity is compared.
EPS = 1e-9


def _shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted by hash, and their places in the order (1 and up)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t.as_py(), words).view(np.int64))], names=["h"])

    some = docs.filter(F.pmod("node", F.lit(SAMPLED)) == 0).select("text").mapInArrow(spared(run), "h bigint")
    found = some.groupBy("h").count().filter(F.col("count") >= COMMON_TEXTS).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order


def _index(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node, n, i) of the indexed shingles of ``docs`` (node, text): n in the set, i before it in the order."""
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(_common(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = told.value
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                batch = big.slice(a, 1000)
                keys, sizes, firsts = [], [], []
                for t in batch.column(1):
                    h = _shingles(t.as_py(), words)
                    if len(h) and len(common):
                        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        h = h[np.argsort(np.where(common[at] == h, place[at], 0), kind="stable")]
                    first = len(h) - int(np.ceil(similarity * len(h) - EPS)) + 1 if len(h) else 0
                    keys.append(h[:first])
                    sizes.append(len(h))
                    firsts.append(first)
                i = np.concatenate([np.arange(k) for k in firsts])
                cols = [np.concatenate(keys).view(np.int64), np.repeat(np.asarray(batch.column(0)), firsts), np.repeat(sizes, firsts).astype(np.int32), i.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n", "i"])

    return docs.select("node", "text").mapInArrow(spared(run), "key bigint, node bigint, n int, i int")


def _met(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node, n, i, m): the index without keys of one text, m texts under the key."""
    index = _index(docs, words, similarity)
    return stage(index.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1"), "met")


def candidates(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that may be similar, once each: all under keys of few texts, and some
    of each crowded key."""
    member = F.struct("node", "n", "i")
    few = met.filter(F.col("m") <= PAIRED).groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("m"))
    each = few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    order = Window.partitionBy("key").orderBy("n", "node")
    crowd = met.filter(F.col("m") > PAIRED).select(member.alias("b"), F.lag(member).over(order).alias("before"), F.first(member).over(order).alias("least"))
    each = each.unionByName(crowd.select(F.explode(F.array("before", "least")).alias("a"), "b").filter("a is not null and a.node <> b.node"))
    most = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))  # shared, if this is the first shared one
    each = each.filter(most * (1 + similarity) >= similarity * (F.col("a.n") + F.col("b.n")) - EPS)
    return each.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): sorted distinct 32-bit hashes of the shingles of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_shingles(t.as_py(), words).astype(np.uint32)).view(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(spared(run), "node bigint, shingles array<int>")


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``_sets`` of the texts whose node is in ``nodes``, once each."""
    wanted = stage(nodes.distinct(), "wanted")
    some = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "node", "left_semi")
    sets = stage(_sets(some, words).dropDuplicates(["node"]), "shingles")
    unstage(wanted)
    return sets


def similar_pairs(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of nodes of ``docs`` (node, text) whose shingle sets reach ``similarity``."""
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = stage(both.filter((common > 0) & (common >= similarity * (F.size("x") + F.size("y") - common) - EPS)).select("a", "b"), "links")
    unstage(sets)
    return found


def _joined(one: list[np.ndarray], two: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets ``one`` and ``two`` are similar, as a matrix."""
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    common = np.zeros((len(one), len(two)), np.float32)
    spots = []
    for side, size in zip((one, two), sizes):
        flat = np.concatenate(side)
        at = np.searchsorted(shared, flat)
        ok = shared[np.minimum(at, len(shared) - 1)] == flat if len(shared) else np.zeros(len(flat), bool)
        at, owner = at[ok], np.repeat(np.arange(len(side)), size)[ok]
        order = np.argsort(at, kind="stable")
        spots.append((at[order], owner[order]))
    for a in range(0, len(shared), STEP):
        part = []
        for (at, owner), size in zip(spots, sizes):
            lo, hi = np.searchsorted(at, [a, a + STEP])
            has = np.zeros((len(size), min(STEP, len(shared) - a)), np.float32)
            has[owner[lo:hi], at[lo:hi] - a] = 1
            part.append(has)
        common += part[0] @ part[1].T
    common = common.astype(np.float64)
    return (common > 0) & (common >= similarity * (sizes[0][:, None] + sizes[1] - common) - EPS)


def _links(group: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between the roots of a block's texts and another's, as many as connect what is similar."""
    group = group.to_pydict() | {"shingles": [np.asarray(x.values) for x in group["shingles"]]}
    side = [[k for k, s in enumerate(group["side"]) if s == want] for want in (0, 1)]
    one, two = side[0], side[1] or side[0]
    root = np.array(group["root"])
    i, j = np.nonzero(_joined([group["shingles"][k] for k in one], [group["shingles"][k] for k in two], similarity))
    met = np.stack([root[one][i], root[two][j]], axis=1)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for a, b in np.unique(met[met[:, 0] != met[:, 1]], axis=0).tolist():
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def crowded_links(docs: DataFrame, met: DataFrame, group: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect what is similar under crowded keys and not yet in one ``group`` (node, root)."""
    crowd = met.filter(F.col("m") > PAIRED).select("key", "node", "n").join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
    same = crowd.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("of")).filter("a <> b")
    keys = same.groupBy("m", "of").agg(F.min("key").alias("key")).select("key")  # keys of the same texts count once
    crowd = crowd.join(keys, "key")
    cost = F.sum(F.col("n").cast("long") + TEXT_COST).over(Window.partitionBy("key").orderBy("n", "node"))
    crowd = stage(crowd.withColumn("block", F.floor(cost / BLOCK_SHINGLES)), "crowd")
    if crowd.isEmpty():
        return crowd.select(F.col("root").alias("a"), F.col("root").alias("b"))
    ends = crowd.groupBy("key", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    pairs = ends.select("key", F.col("block").alias("p"), "hi").join(ends.select("key", F.col("block").alias("q"), "lo"), "key").filter((F.col("p") <= F.col("q")) & (F.col("hi") >= similarity * F.col("lo") - EPS)).select("key", "p", "q")
    sides = pairs.select("key", "p", "q", F.col("p").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("p < q").select("key", "p", "q", F.col("q").alias("block"), F.lit(1).alias("side")))
    sets = _sets_of(docs, crowd.select("node"), words)
    dealt = sides.join(crowd, ["key", "block"]).join(sets, "node").select("key", "p", "q", "side", "root", "shingles")

    def run(group: pa.Table) -> pa.Table:
        found = _links(group, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = stage(dealt.groupBy("key", "p", "q").applyInArrow(run, "a bigint, b bigint"), "more")
    unstage(crowd, sets)
    return found


def print_links(docs: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect the texts of ``docs`` (node, text) whose fingerprints differ in ``bits`` bits or fewer;
    texts without words are left out."""
    prints = stage(fingerprints(docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("node", "text")), "prints")
    of = stage(prints.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    same = prints.join(of, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda name: of.select(F.col("fp").alias(name), F.col("least").alias(f"_{name}"))
    other = links(of.select("fp"), bits).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = stage(same.unionByName(other), "links")
    unstage(prints, of)
    return found


def near_dedup(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with group_id and kept.

    Texts whose sets of ``words``-word shingles (A-Z as a-z) have Jaccard similarity of ``similarity`` or more
    are linked, and with ``bits`` (0 to 2) also those whose fingerprints of three-word shingles, repeats included,
    differ in so many bits or fewer; group_id is the least id of all texts reachable, and one row of each group stays: one with that id, and of
    rows that repeat it in id and text one by a hash of all columns.
    Null ids come last. Equal texts are linked at once, texts without words to each other alone (if equal). No
    link is missed and none is below ``similarity``, but for equal hashes of shingles and those of fingerprints.
    Input columns named like an added one are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("group_id", "kept")
    text = F.coalesce(docs[text_col], F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("node"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    nodes = stage(named.groupBy("node", "id").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(order).alias("best")), "nodes")
    once = named.select("node", "text") if nodes.count() == named.count() else named.select("node", "text").dropDuplicates(["node"])
    met = _met(once, words, similarity)
    pairs = stage(candidates(met, similarity), "pairs")
    found = similar_pairs(named, pairs, words, similarity)
    unstage(pairs)
    if bits is not None:
        found = found.unionByName(print_links(once, bits))
    group = stage(components(found), "group")
    more = crowded_links(named, met, group, words, similarity)
    unstage(met)
    if not more.isEmpty():
        group = components(found.unionByName(more))
    member = stage(nodes.join(group, "node", "left").withColumn("root", F.coalesce("root", "node")), "members")
    best = member.groupBy("root").agg(F.min(F.struct("best", "node")).alias("stay"))
    of = member.join(best, "root").select("node", F.col("stay.best.id").alias("group_id"), F.col("stay.node").alias("stay_node"), (F.col("stay.best.n") > 1).alias("ties"))
    if of.count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    out = docs.withColumn("__node", F.xxhash64(text)).join(of.withColumnRenamed("node", "__node"), "__node")
    first = out.withColumn("kept", (F.col("__node") == F.col("stay_node")) & F.col(id_col).eqNullSafe(F.col("group_id")))
    tied = F.col("kept") & F.col("ties")
    one = Window.partitionBy("__node").orderBy(F.xxhash64(*docs.columns))  # of rows that repeat, in id and text, one that stays
    rows = first.filter(~tied).unionByName(first.filter(tied).withColumn("kept", F.row_number().over(one) == 1))
    return rows.select(*docs.columns, "group_id", "kept")
