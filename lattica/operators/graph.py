"""Property-graph operators over entity, relationship and link tables.

entities (id, name, type, description, community), relationships (source_id, target_id, label, weight,
source_doc), links (chunk_id, entity_id), chunks (chunk_id, filepath, chunk_index).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import slug, stripped
from lattica.sources.shared import checkpointed


def merge_entities(mentions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """One row a slug from ``mentions`` (name, type, description, seq) after ``base`` (id, name, type, description).

    The first name stays, the first type that isn't null, and the longest description (the earlier of equals,
    none if empty). Names without a slug are left out.
    """
    rows = mentions.withColumn("id", slug(F.col("name"))).filter("id <> ''").select("id", stripped(F.col("name")).alias("name"), "type", "description", "seq", F.lit(1).alias("_new"))
    if base is not None:
        rows = rows.unionByName(base.select("id", "name", "type", "description", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("_new")))
    at = F.struct("_new", "seq")
    length = F.length(F.coalesce("description", F.lit("")))
    return rows.groupBy("id").agg(
        F.min_by("name", at).alias("name"),
        F.min_by("type", F.when(F.col("type").isNotNull(), at)).alias("type"),
        F.max_by("description", F.when(length > 0, F.struct(length, -F.col("_new"), -F.col("seq")))).alias("description"),
    )


def merge_relationships(observed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Weights by (source_id, target_id, label, source_doc): one for each of ``observed``, added to ``base``."""
    key = ["source_id", "target_id", "label", "source_doc"]
    new = observed.groupBy(*key).agg(F.count("*").cast("double").alias("weight"))
    if base is None:
        return new
    return new.unionByName(base.select(*key, "weight")).groupBy(*key).agg(F.sum("weight").alias("weight"))


def delete_files(relationships: DataFrame, chunks: DataFrame, links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without what the ``files`` (filepath) contributed."""
    gone = chunks.join(files, "filepath", "left_semi").select("chunk_id")
    return (
        relationships.join(files.withColumnRenamed("filepath", "source_doc"), "source_doc", "left_anti").select(*relationships.columns),
        chunks.join(files, "filepath", "left_anti").select(*chunks.columns),
        links.join(gone, "chunk_id", "left_anti").select(*links.columns),
    )


def gc_orphans(entities: DataFrame, relationships: DataFrame, links: DataFrame) -> DataFrame:
    """Entities that a relationship or a link refers to."""
    used = relationships.select(F.explode(F.array("source_id", "target_id")).alias("id")).unionByName(links.select(F.col("entity_id").alias("id"))).distinct()  # map-side first
    return entities.join(used, "id", "left_semi").select(*entities.columns)


def simple_graph(relationships: DataFrame, weight: str = "last") -> DataFrame:
    """(src, dst, weight): one edge a direction; of parallel edges the last by (label, source_doc), or their sum."""
    value = F.sum("weight") if weight == "sum" else F.max_by("weight", F.struct("label", "source_doc"))
    return relationships.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(value.alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), src <= dst: reciprocal edges as one, with the weight of the edge that starts at the greater end, if there is one."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max_by("weight", F.col("src")).alias("weight"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, id, hop): nodes within ``hops`` of each seed (``seeds``: seed), in either direction, at their least distance."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # repeats go with those of the nodes
    seen = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")).distinct()
    for hop in range(1, hops + 1):
        edge = seen.filter(F.col("hop") == hop - 1).join(both, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(edge).groupBy("seed", "id").agg(F.min("hop").alias("hop"))
    return seen


def induced(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed and the columns of ``relationships``): those with both ends among a seed's nodes (``nodes``: seed, id).

    A relationship is dealt to the seeds of that end of it which fewer seeds have, and then held against the other
    end: a node that all seeds share (a hub) does not list its relationships once a seed. ``nodes`` is read
    several times.
    """
    of = nodes.select("seed", "id")
    held = of.groupBy("id").agg(F.count("*").alias("_held"))
    end = lambda name: held.select(F.col("id").alias(f"{name}_id"), F.col("_held").alias(f"_{name}"))
    both = relationships.join(end("source"), "source_id").join(end("target"), "target_id")
    fewer = F.col("_source") <= F.col("_target")
    both = both.withColumns({"_rare": F.when(fewer, F.col("source_id")).otherwise(F.col("target_id")), "_other": F.when(fewer, F.col("target_id")).otherwise(F.col("source_id"))})
    head = both.join(of.withColumnRenamed("id", "_rare"), "_rare")
    return head.join(of.withColumnRenamed("id", "_other"), ["seed", "_other"], "left_semi").select("seed", *relationships.columns)


def neighborhoods(entities: DataFrame, relationships: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (seed, id, name, type, description) and relationships of the neighbourhoods ``nodes`` (seed, id).

    A seed without edges has its own entity row alone, and nothing if there is none.
    """
    return nodes.select("seed", "id").join(entities.select("id", "name", "type", "description"), "id"), induced(relationships, nodes)


def entities_for_chunks(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct entity_id linked to ``hits`` (chunk_id)."""
    return links.join(hits, "chunk_id", "left_semi").select("entity_id").distinct()


def community_entities(entities: DataFrame, community) -> DataFrame:
    return entities.filter(F.col("community") == community)


def community_relationships(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(community, source_id, target_id, label, weight) of relationships inside one community."""
    of = entities.filter("community is not null").select("id", "community")
    head = relationships.join(of.withColumnRenamed("id", "source_id"), "source_id")
    return head.join(of.withColumnRenamed("id", "target_id"), ["target_id", "community"]).select("community", "source_id", "target_id", "label", "weight")


def stale_communities(communities: DataFrame, entities: DataFrame) -> DataFrame:
    """``communities`` (id, ...) that some entity is still in."""
    active = entities.filter("community is not null").select(F.col("community").alias("id")).distinct()
    return communities.join(active, "id", "left_semi")


def member_hashes(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(community, member_hash): SHA-256 over sorted entity lines, a rule, and sorted inner relationship lines."""
    sep = "\x1f"
    e = entities.filter("community is not null").groupBy("community").agg(F.array_sort(F.collect_list(F.concat_ws(sep, "id", F.coalesce("type", F.lit("")), F.coalesce("description", F.lit(""))))).alias("e"))
    r = community_relationships(entities, relationships).groupBy("community").agg(F.array_sort(F.collect_list(F.concat_ws(sep, "source_id", "target_id", "label"))).alias("r"))
    lines = F.concat("e", F.array(F.lit("---")), F.coalesce("r", F.array().cast("array<string>")))
    return e.join(r, "community", "left").select("community", F.sha2(F.array_join(lines, "\n"), 256).alias("member_hash"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): least node reachable over ``edges`` (src, dst), by label propagation with jumps until nothing changes."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = checkpointed(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("component")).withColumnRenamed("src", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["src"]).select("id", F.least("component", "near").alias("component"), "near")
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("far")), "component")
        now = checkpointed(jump.select("id", F.least("component", "far").alias("component")))
        if now.join(labels, ["id", "component"], "left_anti").isEmpty():
            return now
        labels = now
