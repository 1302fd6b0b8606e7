"""Communities: Louvain by connected component, and refreshed summaries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import stripped
from lattica.models import with_embeddings
from lattica.operators.generation import complete
from lattica.operators.graph import community_relationships, components, member_hashes
from lattica.sources.shared import checkpointed, staged


#: Edges of a graph that is solved in one task a component, and rounds of moves before a larger one is made coarser.
LOCAL_EDGES, ROUNDS = 2_000_000, 8
#: Nodes whose communities are told to all tasks (12 bytes each), and ends of edges of a part of the graph that is packed.
TOLD_NODES, PART_ENDS = 4_000_000, 2_000_000


def louvain_local(edges: list[tuple[str, str, float]], total: float, least_gain: float = 1e-7) -> dict[str, str]:
    """Node -> least node of its community. ``total``: the whole graph's edge weight, which sets the resolution.

    Local moves and aggregation after Blondel et al. (2008); nodes are visited in order and ties go to the
    least community, so that the result depends on the graph alone.
    """
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    number = {n: i for i, n in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    loops = [0.0] * len(names)
    for a, b, w in edges:
        i, j = number[a], number[b]
        if i == j:
            loops[i] += w
        else:
            near[i][j] += w
            near[j][i] += w
    members = [[n] for n in names]
    twice = 2.0 * total
    while True:
        degree = [sum(d.values()) + 2 * loop for d, loop in zip(near, loops)]
        home, inside = list(range(len(near))), degree[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i, links in enumerate(near):
                own = home[i]
                inside[own] -= degree[i]
                to = defaultdict(float)
                for j, w in links.items():
                    to[home[j]] += w
                gain = lambda c: to.get(c, 0.0) - inside[c] * degree[i] / twice  # noqa: B023, E731
                best = min(sorted(to), key=lambda c: (-gain(c), c), default=own)
                if best != own and gain(best) > gain(own) + least_gain:
                    home[i], moved, moved_any = best, True, True
                inside[home[i]] += degree[i]
        if not moved_any:
            return {n: min(group) for group in members for n in group}
        order = {c: k for k, c in enumerate(sorted(set(home)))}
        merged: list[list[str]] = [[] for _ in order]
        new_near: list[dict[int, float]] = [defaultdict(float) for _ in order]
        new_loops = [0.0] * len(order)
        for i, links in enumerate(near):
            c = order[home[i]]
            merged[c] += members[i]
            new_loops[c] += loops[i]
            for j, w in links.items():
                if (d := order[home[j]]) == c:
                    new_loops[c] += w / 2
                else:
                    new_near[c][d] += w
        members, near, loops = merged, new_near, new_loops


def coarsened(edges: DataFrame, total: float, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(id, least) and the edges between communities after ``rounds`` of local moves of all nodes at once.

    In a round the half of the nodes that a hash picks move, each to the neighbouring community of the largest
    gain, given the communities' totals: joins and sums by node and by community, whatever a node's degree. A
    community goes by its least node, so that edges between communities are edges of the same form. ``edges`` are
    read several times.
    """
    found = told_rounds(edges, total, rounds)
    if found is not None:
        return found
    both = edges.filter("src <> dst").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ends = both.select(F.col("src").alias("id"), "weight").unionByName(edges.filter("src = dst").select(F.col("src").alias("id"), (2 * F.col("weight")).alias("weight")))
    home = checkpointed(ends.groupBy("id").agg(F.sum("weight").alias("degree")).withColumn("c", F.col("id")))
    for r in range(rounds):
        sums = home.groupBy("c").agg(F.sum("degree").alias("sum"))
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        near = both.join(home.select(F.col("id").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("weight").alias("w"))
        near = near.join(home.filter(turn), "id").join(sums.withColumnRenamed("c", "to"), "to")
        own = F.col("to") == F.col("c")
        gain = F.col("w") - (F.col("sum") - F.when(own, F.col("degree")).otherwise(0.0)) * F.col("degree") / (2 * total)
        stay = F.when(own, F.col("gain"))
        best = near.withColumn("gain", gain).groupBy("id").agg(F.max(F.struct("gain", F.col("to"))).alias("best"), F.max(stay).alias("stay"), F.first("c").alias("c"), F.first("degree").alias("degree"))
        moves = best.filter(F.col("best.gain") > F.coalesce("stay", F.lit(0.0)) + 1e-7).select("id", F.col("best.to").alias("new"))
        home = checkpointed(home.join(moves, "id", "left").select("id", "degree", F.coalesce("new", "c").alias("c")))
    names = home.groupBy("c").agg(F.min("id").alias("least"))
    member = checkpointed(home.join(names, "c").select("id", "least"))
    of = lambda end, out: member.select(F.col("id").alias(end), F.col("least").alias(out))
    joined = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    return member, checkpointed(joined.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight")))


def numbered(ids: DataFrame, name: str) -> DataFrame:
    """(``name``, n): the distinct values of the only column of ``ids`` numbered from 0 in their order, over all tasks."""
    dealt = staged(ids.toDF(name).distinct().repartitionByRange(name).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return dealt.join(F.broadcast(before), "part").select(name, (F.col("before") + nth - 1).alias("n"))


def _packed(ends: DataFrame) -> DataFrame:
    """One row a part: its nodes, their degrees, how many neighbours they have, these and the edges' weights, from
    ``ends`` (part, a, b, weight); loops count twice in the degree, and are left out."""

    def run(group: pa.Table) -> pa.Table:
        a, b, w = (np.asarray(group[c]) for c in ("a", "b", "weight"))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        nodes, at = np.unique(a, return_inverse=True)
        loop = a == b
        degree = np.bincount(at, np.where(loop, 2 * w, w), len(nodes))
        size = np.bincount(at[~loop], minlength=len(nodes))
        cols = (nodes.astype(np.int32), degree, size.astype(np.int32), b[~loop].astype(np.int32), w[~loop])
        return pa.table({n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(("nodes", "degree", "size", "near", "weight"), cols)})

    return ends.groupBy("part").applyInArrow(run, "nodes binary, degree binary, size binary, near binary, weight binary")


def _moves(nodes: np.ndarray, degree: np.ndarray, size: np.ndarray, near: np.ndarray, weight: np.ndarray, home: np.ndarray, sums: np.ndarray, total: float, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a part that move in round ``r``, and the communities that they move to."""
    mixed = (nodes.astype(np.uint64) + np.uint64(1 + (r << 32))) * np.uint64(0x9E3779B97F4A7C15)
    turn = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) >> np.uint64(40)) & np.uint64(1) == 0
    ends = np.repeat(turn, size)
    key = np.repeat(np.arange(len(nodes)), size)[ends] * len(home) + home[near[ends]]
    if not len(key):
        return nodes[:0], nodes[:0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    to_weight = np.add.reduceat(weight[ends][order], first)
    at, to = key[first] // len(home), key[first] % len(home)
    own = to == home[nodes[at]]
    gain = to_weight - (sums[to] - np.where(own, degree[at], 0)) * degree[at] / (2 * total)
    stay = -(sums[home[nodes]] - degree) * degree / (2 * total)
    stay[at[own]] = gain[own]
    order = np.lexsort((to, gain, at))
    best = order[np.r_[at[order][1:] != at[order][:-1], True]]
    best = best[gain[best] > stay[at[best]] + 1e-7]
    return nodes[at[best]], to[best].astype(np.int32)


def told_rounds(edges: DataFrame, total: float, rounds: int) -> tuple[DataFrame, DataFrame] | None:
    """As ``coarsened``, on numbered nodes and packed neighbours, which are shuffled once; a round tells all tasks the
    nodes' communities, and the driver which nodes move. None for more than TOLD_NODES nodes."""
    spark = edges.sparkSession
    number = staged(numbered(edges.select("src").union(edges.select("dst")), "id"), "numbers")
    n = number.count()
    if n > TOLD_NODES:
        return None
    of = lambda end, out: number.select(F.col("id").alias(end), F.col("n").cast("int").alias(out))
    pairs = staged(edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").select("a", "b", "weight"), "pairs")
    parts = max(1, -(-2 * pairs.count() // PART_ENDS))
    ends = pairs.unionByName(pairs.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    graph = staged(_packed(ends.withColumn("part", F.col("a") % parts)).repartition(parts), "graph")
    home, degree = np.arange(n, dtype=np.int32), np.zeros(n)
    for row in graph.select("nodes", "degree").toLocalIterator():
        degree[np.frombuffer(row["nodes"], np.int32)] = np.frombuffer(row["degree"])
    for r in range(rounds):
        told = spark.sparkContext.broadcast((home, np.bincount(home, degree, n)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    cols = [np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in enumerate((np.int32, float, np.int32, np.int32, float))]
                    found = _moves(*cols, *told.value, total, r)  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=["nodes", "new"])

        moves = graph.mapInArrow(run, "nodes binary, new binary").collect()  # 8 bytes a node at most
        told.destroy()
        home = home.copy()
        for row in moves:
            home[np.frombuffer(row["nodes"], np.int32)] = np.frombuffer(row["new"], np.int32)
        if not any(row["nodes"] for row in moves):
            break
    names = np.full(n, n, np.int32)
    np.minimum.at(names, home, np.arange(n, dtype=np.int32))
    told = spark.sparkContext.broadcast(names[home])

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told.value[np.asarray(batch.column(1))].astype(np.int64))], names=["id", "n"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (told.value[np.asarray(batch.column(c))] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), batch.column(2)], names=["a", "b", "weight"])

    least = number.select("n", F.col("id").alias("least"))
    members = checkpointed(number.mapInArrow(member, f"id {number.schema['id'].dataType.simpleString()}, n bigint").join(least, "n").select("id", "least"))
    joined = staged(pairs.mapInArrow(between, "a int, b int, weight double").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "joined")
    name = lambda end, out: number.select(F.col("n").cast("int").alias(end), F.col("id").alias(out))
    return members, checkpointed(joined.join(name("a", "src"), "a").join(name("b", "dst"), "b").select("src", "dst", "weight"))


def louvain(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, community) for every node of the undirected ``edges`` (src, dst, weight); communities numbered from 0
    by their least member.

    Moves never leave a connected component, so each is solved on its own with the whole graph's weight, in one
    task, where the graph has at most ``local_edges`` edges. A larger one is first coarsened by rounds of moves
    over all tasks, until it is that small or no longer shrinks by a tenth.
    """
    edges = staged(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")  # read by several jobs
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return edges.sparkSession.createDataFrame([], "id string, community int")
    members, size = None, edges.count()
    while size > local_edges:
        found, edges = coarsened(edges, total)
        members = found if members is None else checkpointed(members.join(found.select(F.col("id").alias("least"), F.col("least").alias("up")), "least").select("id", F.col("up").alias("least")))
        before, size = size, edges.count()
        if size > 0.9 * before:
            break
    part = edges.join(components(edges).withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "weight")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = louvain_local(list(zip(rows["src"], rows["dst"], rows["weight"])), total)
        return pd.DataFrame({"id": list(found), "least": list(found.values())})

    found = part.groupBy("component").applyInPandas(solve, "id string, least string")
    if members is not None:
        found = members.withColumnRenamed("least", "of").join(found.withColumnRenamed("id", "of"), "of").select("id", "least")
    found = checkpointed(found)
    order = numbered(found.select("least"), "least").withColumnRenamed("n", "community")
    return found.join(order, "least").select("id", F.col("community").cast("int").alias("community"))


def modularity(edges: DataFrame, membership: DataFrame) -> float:
    """Of a partition (id, community) of undirected ``edges``."""
    total = edges.agg(F.sum("weight")).first()[0]
    of = lambda end: membership.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    inner = edges.join(of("src"), "src").join(of("dst"), "dst").filter("c_src = c_dst").agg(F.sum("weight")).first()[0] or 0.0
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").join(membership, "id").groupBy("community").agg(F.sum("weight").alias("d"))
    return inner / total - ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0] / (4 * total * total)


def assign(entities: DataFrame, membership: DataFrame) -> DataFrame:
    """``entities`` with the community of ``membership`` (id, community), null where it has none."""
    return entities.drop("community").join(membership.select("id", "community"), "id", "left")


def refresh_summaries(entities: DataFrame, relationships: DataFrame, communities: DataFrame, summarise, force: bool = False) -> DataFrame:
    """``communities`` (id, member_hash, summary) brought up to date, with status 'kept' or 'summarised'.

    ``summarise`` maps (community, e: entity structs by id, r: relationship structs) to a column; only
    communities whose hash changed (all with ``force``) use it. Communities without entities are dropped.
    """
    now = member_hashes(entities, relationships).withColumnRenamed("community", "id").withColumnRenamed("member_hash", "now")
    old = communities.select("id", "member_hash", "summary")
    both = now.join(old, "id", "left").withColumn("same", F.lit(not force) & F.coalesce(F.col("member_hash") == F.col("now"), F.lit(False)))
    members = entities.groupBy(F.col("community").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("entity"), "name", "type", "description"))).alias("e"))
    new = both.filter(~F.col("same")).join(members, "id").select("id", F.col("now").alias("member_hash"), summarise(F.col("e")).alias("summary"), F.lit("summarised").alias("status"))
    return both.filter("same").select("id", "member_hash", "summary", F.lit("kept").alias("status")).unionByName(new)


# Our own wording.
SUMMARY_PROMPT = "Say in one short paragraph what the following things have in common and how they work together.\n\nThings:\n"


def summary_prompts(entities: DataFrame, relationships: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, prompt) for ``communities`` (id): their entities by id, and their inner relationships by ids, if there are any."""
    wanted = communities.select("id").distinct()
    of = entities.join(wanted.withColumnRenamed("id", "community"), "community", "left_semi")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")), F.lit("): "), F.coalesce("description", F.lit("")))
    text = lambda rows, key, t: rows.groupBy(F.col("community").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, t.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))
    things = text(of, ["id"], line)
    edge = F.concat(F.lit("- "), F.col("source_id"), F.lit(" --["), F.col("label"), F.lit("]--> "), F.col("target_id"))
    edges = text(community_relationships(of, relationships), ["source_id", "target_id", "label"], edge).withColumnRenamed("lines", "edges")
    rest = F.coalesce(F.concat(F.lit("\n\nConnections:\n"), F.col("edges")), F.lit(""))
    return things.join(edges, "id", "left").select("id", F.concat(F.lit(SUMMARY_PROMPT), F.col("lines"), rest).alias("prompt"))


def summarise_all(entities: DataFrame, relationships: DataFrame, communities: DataFrame, model, embedder, force: bool = False) -> DataFrame:
    """``communities`` (id, member_hash, summary, vector) brought up to date, with status: 'kept' where the members'
    hash is the same, 'summarised', or 'failed' where the model gave nothing.

    A failed community keeps what it had, under its old hash, so that the next run asks again. Communities
    without entities are dropped; all are asked with ``force``.
    """
    now = member_hashes(entities, relationships).select(F.col("community").alias("id"), F.col("member_hash").alias("now"))
    both = now.join(communities.select("id", "member_hash", "summary", "vector"), "id", "left")
    both = both.withColumn("same", F.lit(not force) & F.coalesce(F.col("member_hash") == F.col("now"), F.lit(False)))
    todo = both.filter(~F.col("same"))
    told = complete(todo.join(summary_prompts(entities, relationships, todo.select("id")), "id"), "prompt", model, "answer")
    told = with_embeddings(told.withColumn("answer", F.nullif(stripped(F.col("answer")), F.lit(""))), "answer", embedder, "fresh")
    ok = F.col("answer").isNotNull()
    new = told.select("id", F.when(ok, F.col("now")).otherwise(F.col("member_hash")).alias("member_hash"), F.coalesce("answer", "summary").alias("summary"), F.when(ok, F.col("fresh")).otherwise(F.col("vector")).alias("vector"), F.when(ok, "summarised").otherwise("failed").alias("status"))
    return both.filter("same").select("id", "member_hash", "summary", "vector", F.lit("kept").alias("status")).unionByName(new)


def active_communities(entities: DataFrame) -> DataFrame:
    """(id): communities that some entity is in."""
    return entities.filter("community is not null").select(F.col("community").alias("id")).distinct()


def with_members(communities: DataFrame) -> DataFrame:
    """``communities`` with entity_ids read from its JSON."""
    return communities.withColumn("entity_ids", F.from_json("entity_ids", "array<string>"))


def extractive_summary(members):
    """Offline summary: the names of the first members."""
    return F.concat(F.size(members).cast("string"), F.lit(" entities: "), F.array_join(F.slice(F.transform(members, lambda m: m["name"]), 1, 10), ", "))
