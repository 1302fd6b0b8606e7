"""Entity and relationship extraction: batches of chunks, model answers, and their normal form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import DEFAULT
from lattica.functions.text import mentions, recover_json, slug, stripped, token_estimate
from lattica.operators.generation import complete

SEPARATOR = "\n\n---\n\n"


# Our own wording; the keys are what ``parse_answers`` reads.
EXTRACTION_PROMPT = """List what the text below speaks of and how it is connected.
Answer with one JSON object and nothing else. Its "entities" are objects with "name", "type" (such as CLASS, FUNCTION, MODULE, PERSON, PLACE or CONCEPT) and "description" (one sentence). Its "relationships" are objects with "source", "target" (names of entities) and "label" (a verb).

Text:
"""


def pack_batches(chunks: DataFrame, budget: int = DEFAULT.batch_tokens) -> DataFrame:
    """(filepath, chunk_index, tokens, batch_index): chunks in order, a new batch where the next would exceed
    ``budget`` estimated tokens; one too large is a batch of its own. Each decision needs the one before, so
    sorted rows stream through with a running total; a file is not held."""
    rows = chunks.select("filepath", F.col("chunk_index").cast("int").alias("chunk_index"), token_estimate(F.col("text")).alias("tokens"))
    kind = rows.schema["filepath"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, number, held = object(), 0, 0
        for batch in batches:
            out = []
            for p, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p != path:
                    path, number, held = p, 0, 0
                elif held + tokens > budget:
                    number, held = number + 1, 0
                held += tokens
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["filepath", "chunk_index", "tokens", "batch_index"])

    ordered = rows.repartition("filepath").sortWithinPartitions("filepath", "chunk_index")
    return ordered.mapInArrow(run, f"filepath {kind}, chunk_index int, tokens bigint, batch_index int")


def batch_texts(chunks: DataFrame, budget: int = DEFAULT.batch_tokens) -> DataFrame:
    """(filepath, batch_index, text) of the batches."""
    packed = chunks.join(pack_batches(chunks, budget).drop("tokens"), ["filepath", "chunk_index"])
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return packed.groupBy("filepath", "batch_index").agg(F.array_join(F.transform(parts, lambda p: p["text"]), SEPARATOR).alias("text"))


_ENTITY = "struct<name string, type string, description string>"
_EDGE = "struct<source string, target string, label string>"


def parse_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (filepath, batch_index, result) with entities, relationships and had_failure.

    Anything but a list counts as an empty one, items that aren't objects are left out, and values are
    read as text. had_failure: there was no answer (null result), which is what a failed call leaves.
    """
    schema = pa.schema([("filepath", pa.string()), ("batch_index", pa.int32()), ("entities", pa.list_(pa.struct([(k, pa.string()) for k in ("name", "type", "description")]))), ("relationships", pa.list_(pa.struct([(k, pa.string()) for k in ("source", "target", "label")]))), ("had_failure", pa.bool_())])

    def items(data, field: str, keys: tuple[str, ...]) -> list[dict]:
        found = data.get(field) if isinstance(data, dict) else None
        text = lambda v: v if v is None or isinstance(v, str) else str(v)
        return [{k: text(x.get(k)) for k in keys} for x in found if isinstance(x, dict)] if isinstance(found, list) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, index, result in zip(*(c.to_pylist() for c in b.columns)):
                data = recover_json(result)
                rows.append(dict(filepath=path, batch_index=index, entities=items(data, "entities", ("name", "type", "description")), relationships=items(data, "relationships", ("source", "target", "label")), had_failure=result is None))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return answers.select("filepath", F.col("batch_index").cast("int"), "result").mapInArrow(run, f"filepath string, batch_index int, entities array<{_ENTITY}>, relationships array<{_EDGE}>, had_failure boolean")


def normal_entities(parsed: DataFrame) -> DataFrame:
    """(filepath, id, name, type, description): one a slug and file, in order of batch and position."""
    rows = parsed.select("filepath", "batch_index", F.posexplode("entities").alias("pos", "e")).select("filepath", F.struct("batch_index", "pos").alias("at"), stripped(F.col("e.name")).alias("name"), F.col("e.type").alias("type"), F.col("e.description").alias("description"))
    rows = rows.withColumn("id", slug(F.col("name"))).filter("id <> ''")
    length = F.length(F.coalesce("description", F.lit("")))
    return rows.groupBy("filepath", "id").agg(
        F.min_by("name", "at").alias("name"),
        F.min_by("type", F.when(F.col("type") != "", F.col("at"))).alias("type"),
        F.max_by("description", F.when(length > 0, F.struct(length, -F.col("at.batch_index"), -F.col("at.pos")))).alias("description"),
    )


def normal_relationships(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, label, source_doc), repeats kept: those whose ends are among the file's entities."""
    rows = parsed.select("filepath", F.explode("relationships").alias("r")).select("filepath", stripped(F.col("r.source")).alias("s"), stripped(F.col("r.target")).alias("t"), stripped(F.col("r.label")).alias("label"))
    rows = rows.filter("s <> '' and t <> '' and label <> ''").select("filepath", slug(F.col("s")).alias("source_id"), slug(F.col("t")).alias("target_id"), "label")
    for end in ("source_id", "target_id"):
        rows = rows.join(entities.select("filepath", F.col("id").alias(end)), ["filepath", end], "left_semi")
    return rows.select("source_id", "target_id", "label", F.col("filepath").alias("source_doc"))


def link_chunks(chunks: DataFrame, entities: DataFrame, least: int = DEFAULT.min_entity_name_chars) -> DataFrame:
    """Distinct (chunk_id, entity_id) where a chunk of the entity's file names it between word boundaries.

    ``chunks``: (chunk_id, filepath, text); ``entities``: (filepath, id, name).
    """
    named = entities.select("filepath", F.col("id").alias("entity_id"), stripped(F.col("name")).alias("name")).filter(F.length("name") >= least)
    return chunks.join(named, "filepath").filter(mentions(F.col("text"), F.col("name"))).select("chunk_id", "entity_id").distinct()


def resume(batches: DataFrame, cache: DataFrame) -> DataFrame:
    """``batches`` (filepath, sha256, batch_index, text) with the cached result, null where the model has to run."""
    return batches.join(cache.select("filepath", "sha256", "batch_index", "result"), ["filepath", "sha256", "batch_index"], "left")


def extraction_prompts(batches: DataFrame) -> DataFrame:
    """``batches`` (filepath, batch_index, text, ...) with the prompt that asks for their entities and relationships."""
    return batches.withColumn("prompt", F.concat(F.lit(EXTRACTION_PROMPT), F.coalesce("text", F.lit(""))))


def extract(batches: DataFrame, cache: DataFrame, model) -> DataFrame:
    """``batches`` (filepath, sha256, batch_index, text) with result, and fresh: whether the model gave it now.

    Cached answers are used as they are; the others come from ``model`` in JSON form. A call that fails leaves a
    null result, which is not to be cached, and touches no other batch.
    """
    known = resume(batches, cache)
    asked = extraction_prompts(known.filter(F.col("result").isNull()).drop("result"))
    told = complete(asked, "prompt", model, "result", form="json").drop("prompt", "error")
    return told.withColumn("fresh", F.lit(True)).unionByName(known.filter(F.col("result").isNotNull()).withColumn("fresh", F.lit(False)))


def cache_clear(cache: DataFrame, files: DataFrame) -> DataFrame:
    """``cache`` without the answers for ``files`` (filepath)."""
    return cache.join(files.select("filepath"), "filepath", "left_anti").select(*cache.columns)


def cached_answers(cache: DataFrame) -> DataFrame:
    """(filepath, answers): a map from batch to answer for each file."""
    return cache.groupBy("filepath").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("batch_index", "result")))).alias("answers"))


def link_append(links: DataFrame, new: DataFrame) -> DataFrame:
    """``links`` (chunk_id, entity_id) and those of ``new`` that aren't there, once each."""
    return links.unionByName(new.select(*links.columns).distinct().join(links, ["chunk_id", "entity_id"], "left_anti"))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """``cache`` with the rows of ``new`` in place of those of the same key."""
    key = ["filepath", "sha256", "batch_index"]
    return cache.join(new, key, "left_anti").unionByName(new)


def order_index(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with chunk_index, 0 upwards in each ``key``."""
    return rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
