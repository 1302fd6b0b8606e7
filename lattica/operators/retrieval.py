"""Local and global retrieval, routing, and prompts, for a batch of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import DEFAULT, EngineConfig
from lattica.functions.text import heuristic_route, identifiers, stripped
from lattica.functions.vector import cosine_topk
from lattica.operators.graph import k_hop, neighborhoods
from lattica.sources.shared import staged


def definition_lookup(questions: DataFrame, chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(question_id, ident_rank, def_name, chunk_id, chunk_index, text): chunks defining the first identifiers
    of ``questions`` (question_id, question); at most pieces by limit for each question, in order of rank and index."""
    wanted = questions.select("question_id", F.posexplode(F.slice(identifiers(F.col("question")), 1, config.max_identifiers)).alias("ident_rank", "def_name"))
    found = wanted.join(chunks.filter("text is not null and def_name is not null"), "def_name")
    order = Window.partitionBy("question_id").orderBy("ident_rank", "chunk_index", "chunk_id")
    most = config.max_identifiers * config.max_pieces_per_def
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("question_id", "ident_rank", "def_name", "chunk_id", "chunk_index", "text")


def context_texts(hits: DataFrame, defined: DataFrame) -> DataFrame:
    """(question_id, rank, text): the texts of vector ``hits`` (question_id, rank, text) with repeats, then those
    defined that aren't among them, once each."""
    first = hits.filter("text is not null").select("question_id", F.struct(F.lit(0).alias("k"), F.col("rank").alias("a"), F.lit(0).alias("b")).alias("at"), "text")
    own = defined.join(first.select("question_id", "text"), ["question_id", "text"], "left_anti")
    own = own.groupBy("question_id", "text").agg(F.min(F.struct(F.lit(1).alias("k"), F.col("ident_rank").cast("int").alias("a"), F.col("chunk_index").cast("int").alias("b"))).alias("at"))
    both = first.unionByName(own.select("question_id", "at", "text"))
    return both.select("question_id", F.row_number().over(Window.partitionBy("question_id").orderBy("at")).alias("rank"), "text")


def seed_entities(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(question_id, entity_id, seed_rank): entities linked to ``hits`` (question_id, id, rank), by best hit and id."""
    found = hits.join(links.withColumnRenamed("chunk_id", "id"), "id").groupBy("question_id", "entity_id").agg(F.min("rank").alias("hit"))
    return found.select("question_id", "entity_id", F.row_number().over(Window.partitionBy("question_id").orderBy("hit", "entity_id")).alias("seed_rank"))


def needed_seeds(seeds: DataFrame, nodes: DataFrame, entities: DataFrame, config: EngineConfig = DEFAULT, edges: DataFrame | None = None) -> DataFrame:
    """Those of ``seeds`` whose neighbourhoods can reach a question's capped result.

    Results come seed by seed. A neighbourhood of n nodes is connected, so it has n - 1 relationships at least:
    behind a seed that alone fills both caps no other counts. ``nodes``: (seed, id) of the neighbourhoods, or of
    smaller ones inside them. With ``edges`` (src, dst), all neighbours of ``nodes`` are in the neighbourhoods too:
    one node with many is enough.
    """
    of_id = entities.select("id").withColumn("known", F.lit(1))
    known = nodes.join(of_id, "id", "left")
    size = known.groupBy(F.col("seed").alias("entity_id")).agg(F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("known"))
    full = (F.col("n") - 1 >= config.max_relationships) & (F.col("known") >= config.max_entities)
    size = size.select("entity_id", full.alias("full"))
    if edges is not None:
        both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"))).filter("id <> to")
        near = both.join(nodes.select("id").distinct(), "id", "left_semi").distinct().join(of_id.withColumnRenamed("id", "to"), "to", "left")
        wide = near.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("known")).filter((F.col("n") >= config.max_relationships) & (F.col("known") >= config.max_entities))
        size = size.unionByName(nodes.join(wide.select("id"), "id", "left_semi").select(F.col("seed").alias("entity_id"), F.lit(True).alias("full")))
        size = size.groupBy("entity_id").agg(F.bool_or("full").alias("full"))
    last = F.min(F.when(F.col("full"), F.col("seed_rank"))).over(Window.partitionBy("question_id"))
    rows = seeds.join(size, "entity_id", "left").withColumn("last", last)
    return rows.filter(F.col("last").isNull() | (F.col("seed_rank") <= F.col("last"))).select(*seeds.columns)


def merge_neighborhoods(seeds: DataFrame, around: tuple[DataFrame, DataFrame], config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Entities (question_id, rank, id, ...) and relationships of each question's seeds, first seen first, capped.

    Order is the contract here: entities by (seed rank, id), relationships by (seed rank, source, target,
    label, document); relationships of other documents with the same ends and label count once. Of one seed only
    the first can be in a result, as many as its cap: those before them that earlier seeds have fill it as well.
    """
    entities, relationships = around
    first = lambda rows, key, most: rows.withColumn("_nth", F.dense_rank().over(Window.partitionBy("seed").orderBy(*key))).filter(F.col("_nth") <= most).drop("_nth")
    entities, relationships = first(entities, ["id"], config.max_entities), first(relationships, ["source_id", "target_id", "label"], config.max_relationships)
    of = seeds.select("question_id", F.col("entity_id").alias("seed"), "seed_rank")
    e = entities.join(of, "seed").groupBy("question_id", "id").agg(F.min("seed_rank").alias("s"), F.first("name").alias("name"), F.first("type").alias("type"), F.first("description").alias("description"))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("s", "id"))).filter(F.col("rank") <= config.max_entities).drop("s")
    r = relationships.join(of, "seed").groupBy("question_id", "source_id", "target_id", "label").agg(F.min(F.struct("seed_rank", "source_doc", "weight")).alias("m"))
    order = Window.partitionBy("question_id").orderBy("m.seed_rank", "source_id", "target_id", "label")
    r = r.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.max_relationships)
    return e, r.select("question_id", "rank", "source_id", "target_id", "label", F.col("m.weight").alias("weight"))


def local_retrieve(questions: DataFrame, chunks: DataFrame, links: DataFrame, entities: DataFrame, relationships: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relationships and texts for ``questions`` (question_id, question, vector) over
    ``chunks`` (chunk_id, vector, text, def_name, chunk_index). Neighbourhoods are found once a seed."""
    near = cosine_topk(questions, chunks.select(F.col("chunk_id").alias("id"), "vector"), config.retrieval_k)
    near, relationships = staged(near, "near"), staged(relationships, "relationships")  # read by several branches
    seeds = staged(seed_entities(near, links), "seeds")
    edges = relationships.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    of = lambda rows: rows.select(F.col("entity_id").alias("seed")).distinct()
    around = staged(k_hop(edges, of(seeds), min(1, config.hops)).select("seed", "id"), "around")  # needed seeds are told by the first hop, and what hangs on it
    seeds = staged(needed_seeds(seeds, around, entities, config, edges if config.hops > 1 else None), "needed")
    nodes = staged(k_hop(edges, of(seeds), config.hops).select("seed", "id"), "nodes")
    e, r = merge_neighborhoods(seeds, neighborhoods(entities, relationships, nodes), config)
    hits = near.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id").select("question_id", "rank", "text")
    return e, r, context_texts(hits, definition_lookup(questions, chunks, config))


def global_retrieve(questions: DataFrame, communities: DataFrame, n: int = DEFAULT.communities_n) -> DataFrame:
    """(question_id, id, summary, score, rank): the ``n`` communities (id, summary, vector) nearest to each question;
    ties to the greater id; those without summary or vector of the question's size left out."""
    usable = communities.filter("vector is not null and summary <> ''")
    near = cosine_topk(questions, usable.select("id", "vector"), n, descending_ids=True)
    return near.join(usable.select("id", "summary"), "id")


def route(questions: DataFrame, available: DataFrame, classifier=None) -> DataFrame:
    """``questions`` with route: local where no community is usable; else the classifier's answer if it is one
    of the two, else the heuristic. ``available``: one row, column available."""
    answer = F.lower(stripped(classifier(F.col("question")))) if classifier else F.lit(None).cast("string")
    chosen = F.when(answer.isin("local", "global"), answer).otherwise(heuristic_route(F.col("question")))
    return questions.crossJoin(F.broadcast(available.limit(1))).withColumn("route", F.when(F.col("available"), chosen).otherwise("local")).drop("available")


def communities_available(communities: DataFrame) -> DataFrame:
    return communities.agg(F.coalesce(F.bool_or(F.col("vector").isNotNull() & (F.col("summary") != "")), F.lit(False)).alias("available"))


def plan(routed: DataFrame, mode: str, global_hits: DataFrame) -> DataFrame:
    """(question_id, plan): 'global' where the mode or the route says so and something was found, else 'local'."""
    if mode not in ("auto", "local", "global"):
        raise ValueError(f"unknown mode {mode!r}")
    found = global_hits.select("question_id").distinct().withColumn("found", F.lit(True))
    want = {"auto": F.col("route") == "global", "local": F.lit(False), "global": F.lit(True)}[mode]
    return routed.join(found, "question_id", "left").select("question_id", F.when(want & F.coalesce("found", F.lit(False)), "global").otherwise("local").alias("plan"))


def capped_texts(texts: DataFrame, key: str, most: int = DEFAULT.max_chunk_block_chars) -> DataFrame:
    """The first text of each ``key`` by rank, and those after it as long as all together have ``most`` characters."""
    total = F.sum(F.length("text")).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(key).orderBy("rank")) == 1
    return texts.withColumns({"total": total, "first": first}).filter(F.col("first") | (F.col("total") <= most)).drop("total", "first")


def local_prompts(questions: DataFrame, e: DataFrame, r: DataFrame, texts: DataFrame, most: int = DEFAULT.max_chunk_block_chars) -> DataFrame:
    """(question_id, prompt): entities, relationships by name (the id where none is known), texts, question."""
    line = lambda rows, text: rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
    described = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")), F.lit("): "), F.coalesce("description", F.lit("")))
    names = e.select("question_id", "id", "name")
    named = r.join(names.select("question_id", F.col("id").alias("source_id"), F.col("name").alias("s")), ["question_id", "source_id"], "left").join(names.select("question_id", F.col("id").alias("target_id"), F.col("name").alias("t")), ["question_id", "target_id"], "left")
    edge = F.concat(F.lit("- "), F.coalesce("s", "source_id"), F.lit(" --["), F.col("label"), F.lit("]--> "), F.coalesce("t", "target_id"))
    capped = capped_texts(texts, "question_id", most).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("block"))
    out = questions.select("question_id", "question")
    for name, rows in (("e", line(e, described)), ("r", line(named, edge)), ("c", capped)):
        out = out.join(rows.withColumnRenamed("block", name), "question_id", "left")
    block = lambda name: F.coalesce(name, F.lit("(none)"))
    return out.select("question_id", F.concat(F.lit("Known entities:\n"), block("e"), F.lit("\n\nRelations:\n"), block("r"), F.lit("\n\nPassages:\n"), block("c"), F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def global_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(question_id, prompt): the communities' summaries by rank, then the question."""
    part = F.concat(F.lit("Community "), F.col("id").cast("string"), F.lit(":\n"), F.col("summary"))
    blocks = hits.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n").alias("block"))
    return questions.join(blocks, "question_id").select("question_id", F.concat("block", F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))
