"""The index run: what changed is cleaned up, chunked, embedded, extracted, merged and linked, and committed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import DEFAULT, EngineConfig
from lattica.models import with_embeddings
from lattica.operators import extraction, graph, incremental
from lattica.operators.chunking import chunk_documents
from lattica.sources.shared import checkpointed

SCHEMAS = {
    "entities": "id string, name string, type string, description string, community int",
    "relationships": "source_id string, target_id string, label string, source_doc string, weight double",
    "chunks": "chunk_id string, filepath string, chunk_index int, text string, def_name string, vector array<float>",
    "links": "chunk_id string, entity_id string",
    "cache": "filepath string, sha256 string, batch_index int, result string",
    "fingerprints": "filepath string, sha256 string",
    "communities": "id int, member_hash string, summary string, vector array<float>",
}


def open_store(spark: SparkSession, folder: str) -> incremental.Store:
    return incremental.Store(spark, folder, SCHEMAS)


def check_vectors(chunks: DataFrame, dimension: int) -> None:
    """Raise an error if a stored vector has another size."""
    odd = chunks.filter(F.col("vector").isNotNull() & (F.size("vector") != dimension)).select(F.size("vector").alias("n")).first()
    if odd:
        raise RuntimeError(f"the store's vectors have {odd['n']} numbers, the vector size is set to {dimension}")


def ensure_vectors(store: incremental.Store, dimension: int) -> None:
    """An empty vector table where there is none; else the stored vectors must have the size."""
    if "chunks" in store.versions():
        check_vectors(store.read("chunks"), dimension)
    else:
        store.commit({"chunks": store.read("chunks")})


def chunks_of(chunks: DataFrame, filepath: str) -> DataFrame:
    return chunks.filter(F.col("filepath") == filepath).orderBy("chunk_index")


def index(store: incremental.Store, files: DataFrame, embedder, model, config: EngineConfig = DEFAULT) -> DataFrame:
    """(filepath, outcome) after indexing ``files`` (filepath, sha256, text): indexed, skipped or failed.

    Unchanged files are skipped. What changed or vanished loses its chunks, vectors, links and edges, and what
    nothing refers to any more goes; answers cached for other contents go too. New and changed files are chunked,
    embedded and extracted, batch by batch; a file any of whose batches failed keeps what was found, its answers
    are cached, and it gets no fingerprint, so that the next run takes it up where this one stopped. All tables
    are committed together.
    """
    ensure_vectors(store, embedder.dimension)
    old = {name: store.read(name) for name in ("entities", "relationships", "chunks", "links", "cache", "fingerprints")}
    files = checkpointed(files.select("filepath", "sha256", "text"))
    changes = checkpointed(incremental.detect_changes(files, old["fingerprints"]))
    todo = files.join(changes.filter("status in ('new', 'changed')"), "filepath", "left_semi")
    gone = changes.filter("status in ('new', 'changed', 'stale')").select("filepath")  # a new file may have parts of a run that failed
    edges, chunks, links = graph.delete_files(old["relationships"], old["chunks"], old["links"], gone)
    stale = old["cache"].join(files.select("filepath", "sha256"), ["filepath", "sha256"], "left_anti").select("filepath", "sha256").distinct()
    cache = old["cache"].join(stale, ["filepath", "sha256"], "left_anti").select(*old["cache"].columns)

    pieces = chunk_documents(todo.select("filepath", "text"), config).join(todo.select("filepath", "sha256"), "filepath")
    pieces = with_embeddings(incremental.chunk_ids(pieces), "text", embedder, limit=config.max_embed_chars)
    pieces = checkpointed(pieces)
    batches = extraction.batch_texts(pieces.select("filepath", "chunk_index", "text"), config.batch_tokens).join(todo.select("filepath", "sha256"), "filepath")
    told = checkpointed(extraction.extract(batches, cache, model))
    parsed = checkpointed(extraction.parse_answers(told))
    failed = parsed.filter("had_failure").select("filepath").distinct()
    found = checkpointed(extraction.normal_entities(parsed))
    seen = extraction.normal_relationships(parsed, found)
    mentions = found.select("name", "type", "description", F.struct("filepath", "id").alias("at"))
    merged = graph.merge_entities(mentions.withColumn("seq", F.xxhash64("at")).drop("at"), old["entities"])
    merged = merged.join(old["entities"].select("id", "community"), "id", "left").select(*old["entities"].columns)
    edges = graph.merge_relationships(seen, edges).select(*old["relationships"].columns)
    links = extraction.link_append(links, extraction.link_chunks(pieces, found, config.min_entity_name_chars))
    fresh = told.filter("fresh and result is not null").select(*old["cache"].columns)
    done = pieces.select("filepath", "sha256").distinct().join(failed, "filepath", "left_anti")  # a file without chunks gets none
    same = old["fingerprints"].join(changes.filter("status = 'unchanged'"), "filepath", "left_semi")
    store.commit({
        "entities": graph.gc_orphans(merged, edges, links), "relationships": edges, "links": links,
        "chunks": chunks.unionByName(pieces.select(*old["chunks"].columns)),
        "cache": extraction.cache_put(cache, fresh), "fingerprints": done.unionByName(same),
    })
    return incremental.file_status(files, changes, pieces, failed)
