"""Registered queries of the engine, and the SQL they are checked against."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.config import DEFAULT
from lattica import models
from lattica.functions import network
from lattica.functions import text as tx
from lattica.functions.vector import cosine_topk, right_size
from lattica.operators import chat, chunking, community, extraction, generation, graph, incremental, indexing, retrieval
from lattica.plans import star
from lattica.plans.star import SQL as STAR
from lattica.plans.star import read
from lattica.sources import files
from lattica.sources.shared import shared_dir, staged
from lattica.streaming import limiter

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filepath"), "doc_id", "source", "text", F.sha2("text", 256).alias("sha256"))


_SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    parts = [("region", "r_name", "'REGION'", "cast(null as string)", "r_regionkey"), ("nation", "n_name", "'NATION'", "cast(null as string)", "n_nationkey"), ("supplier", "s_name", "'SUPPLIER'", "cast(null as string)", "s_suppkey"), ("customer", "c_name", "cast(null as string)", "c_mktsegment", "c_custkey"), ("part", "p_name", "p_type", "p_brand", "p_partkey")]
    out = None
    for i, (table, name, kind, text, key) in enumerate(parts):
        rows = read(spark, d, table).selectExpr(f"{name} as name", f"{kind} as type", f"{text} as description", f"cast({i} * 1000000000000 + {key} as bigint) as seq")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""
WITH m AS (
  SELECT r_name AS name, 'REGION' AS type, NULL AS description, CAST(r_regionkey AS BIGINT) AS seq FROM region
  UNION ALL SELECT n_name, 'NATION', NULL, 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT s_name, 'SUPPLIER', NULL, 2000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT c_name, NULL, c_mktsegment, 3000000000000 + c_custkey FROM customer
  UNION ALL SELECT p_name, p_type, p_brand, 4000000000000 + p_partkey FROM part),
s AS (SELECT *, {_SLUG.format('name')} AS id FROM m)
SELECT id, arg_min(trim(name), seq) AS name, arg_min(type, seq) FILTER (type IS NOT NULL) AS type,
  (list(description ORDER BY length(description) DESC, seq) FILTER (length(coalesce(description, '')) > 0))[1] AS description
FROM s WHERE id <> '' GROUP BY id""")
def entity_upsert_merge(spark, d):
    return graph.merge_entities(_mentions(spark, d))


def _relationships(spark, d):
    return graph.merge_relationships(star.observed(spark, d))


@query(STAR + "SELECT * FROM r")
def relationship_upsert_weight(spark, d):
    return _relationships(spark, d)


@query(STAR + """SELECT e.id, e.name, e.type FROM e WHERE id IN (
  SELECT source_id FROM r WHERE source_doc <> 'lineitem' UNION SELECT target_id FROM r WHERE source_doc <> 'lineitem' UNION SELECT entity_id FROM k)""")
def orphan_gc_after_delete(spark, d):
    rel, links = staged(_relationships(spark, d), "relationships"), star.links(spark, d)
    chunks = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("vectors").alias("filepath"))
    gone = spark.createDataFrame([("lineitem",)], "filepath string")
    rel, _, links = graph.delete_files(rel, chunks, links, gone)
    return graph.gc_orphans(star.entities(spark, d), rel, links).select("id", "name", "type")


@query(STAR + "SELECT source_id AS src, target_id AS dst, arg_max(weight, (label, source_doc)) AS weight FROM r GROUP BY ALL")
def simple_graph_collapse(spark, d):
    return graph.simple_graph(_relationships(spark, d))


@query(STAR + "SELECT least(source_id, target_id) AS src, greatest(source_id, target_id) AS dst, arg_max(weight, source_id) AS weight FROM r GROUP BY ALL")
def undirected_view(spark, d):
    return graph.undirected(graph.simple_graph(_relationships(spark, d)))


_HOPS = STAR + """, b AS (SELECT source_id AS src, target_id AS dst FROM r UNION SELECT target_id, source_id FROM r),
h AS (SELECT s AS seed, s AS id, 0 AS hop FROM (SELECT 'supplier_' || s_suppkey AS s FROM supplier WHERE s_suppkey % 20 = 0 UNION ALL SELECT 'region_' || r_regionkey FROM region WHERE r_regionkey % 20 = 0)
      UNION SELECT h.seed, b.dst, h.hop + 1 FROM h JOIN b ON h.id = b.src WHERE h.hop < 2),
n AS (SELECT seed, id, min(hop) AS hop FROM h GROUP BY ALL)
"""


def _seeds(spark, d):
    """The stated query set: suppliers and regions whose key is divisible by 20."""
    own = read(spark, d, "supplier").filter("s_suppkey % 20 = 0").selectExpr("concat('supplier_', s_suppkey) as seed")
    return own.union(read(spark, d, "region").filter("r_regionkey % 20 = 0").selectExpr("concat('region_', r_regionkey) as seed"))


@query(_HOPS + "SELECT * FROM n")
def k_hop_neighborhood(spark, d):
    return graph.k_hop(staged(graph.simple_graph(_relationships(spark, d)), "edges"), _seeds(spark, d), 2)


@query(_HOPS + "SELECT x.seed, r.source_id, r.target_id, r.label, r.weight FROM r JOIN n x ON x.id = source_id JOIN n y ON y.id = target_id AND x.seed = y.seed")
def induced_relationships(spark, d):
    rel = staged(_relationships(spark, d), "relationships")
    pairs = rel.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    nodes = staged(graph.k_hop(pairs, _seeds(spark, d), 2).select("seed", "id"), "nodes")
    return graph.induced(rel, nodes).select("seed", "source_id", "target_id", "label", "weight")


@query(STAR + "SELECT id, name, type, description FROM e WHERE community = 2")
def community_entities(spark, d):
    return graph.community_entities(star.entities(spark, d), 2).select("id", "name", "type", "description")


@query(STAR + "SELECT x.community, r.source_id, r.target_id, r.label, r.weight FROM r JOIN e x ON x.id = source_id JOIN e y ON y.id = target_id AND x.community = y.community")
def community_relationships(spark, d):
    return graph.community_relationships(star.entities(spark, d), _relationships(spark, d))


@query(STAR + """, l AS (SELECT community, list_sort(list(concat_ws(chr(31), id, coalesce(type, ''), coalesce(description, '')))) AS l FROM e WHERE community IS NOT NULL GROUP BY 1),
i AS (SELECT x.community, list_sort(list(concat_ws(chr(31), source_id, target_id, label))) AS l FROM r JOIN e x ON x.id = source_id JOIN e y ON y.id = target_id AND x.community = y.community GROUP BY 1)
SELECT l.community, sha256(array_to_string(list_concat(l.l, ['---'], coalesce(i.l, [])), chr(10))) AS member_hash FROM l LEFT JOIN i USING (community)""")
def member_hash(spark, d):
    return graph.member_hashes(star.entities(spark, d), _relationships(spark, d))


@query("SELECT label AS id FROM embeddings WHERE label IN (SELECT n_regionkey FROM nation) GROUP BY 1")
def stale_communities(spark, d):
    known = read(spark, d, "embeddings").select(F.col("label").alias("id")).distinct()
    return graph.stale_communities(known, star.entities(spark, d))


_COSINE = """CASE WHEN list_dot_product({0}, {0}) = 0 OR list_dot_product({1}, {1}) = 0 THEN 0.0 ELSE list_dot_product({0}, {1}) / sqrt(list_dot_product({0}, {0})) / sqrt(list_dot_product({1}, {1})) END"""
_TOPK = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT q.vec_id AS question_id, v.vec_id AS id, round(" + _COSINE.format("q.e", "v.e") + ", 6) AS score FROM v q JOIN v ON q.vec_id % 20 = 0), hit AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM t QUALIFY rank <= 5)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _questions(spark, d):
    """The stated query set: every vector whose number is divisible by 20."""
    return _vectors(spark, d).filter("id % 20 = 0").withColumnRenamed("id", "question_id")


@query(f"WITH {_TOPK} SELECT question_id, id, score, CAST(rank AS INTEGER) AS rank FROM hit")
def vector_topk_cosine(spark, d):
    return cosine_topk(_questions(spark, d), _vectors(spark, d), 5)


_CENTRES = "c AS (SELECT label AS id, list(m ORDER BY i) AS e FROM (SELECT label, i, round(avg(x), 9) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)"


@query(f"WITH {_CENTRES}, q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT q.vec_id AS question_id, c.id, round({_COSINE.format('q.e', 'c.e')}, 6) AS score FROM q JOIN c ON true) "
       "SELECT question_id, id, score, 'label ' || id AS summary, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM t QUALIFY rank <= 5")
def global_topn_communities(spark, d):
    each = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    centres = mean.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    named = centres.withColumn("summary", F.concat(F.lit("label "), F.col("id").cast("string")))
    return retrieval.global_retrieve(_questions(spark, d), named, 5)


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0")
def vector_dim_mismatch_filter(spark, d):
    mixed = _vectors(spark, d).withColumn("vector", F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")))
    return mixed.filter(right_size(F.col("vector"), 64)).select("id")


_LOCAL = STAR + f""", {_TOPK},
sd AS (SELECT question_id, entity_id, row_number() OVER (PARTITION BY question_id ORDER BY min(hit.rank), entity_id) AS s FROM hit JOIN k ON hit.id = k.chunk_id GROUP BY question_id, entity_id),
b AS (SELECT source_id AS src, target_id AS dst FROM r UNION SELECT target_id, source_id FROM r),
u AS (SELECT DISTINCT entity_id AS seed FROM sd),
n1 AS (SELECT seed, seed AS id FROM u UNION SELECT seed, dst FROM u JOIN b ON src = seed),
n AS (SELECT seed, id FROM n1 UNION SELECT seed, dst FROM n1 JOIN b ON src = id),
ent AS (SELECT question_id, e.id, e.name AS label, min(s) AS s FROM sd JOIN n ON n.seed = sd.entity_id JOIN e ON e.id = n.id GROUP BY ALL),
rel AS (SELECT question_id, source_id, target_id, r.label, min(s) AS s FROM sd JOIN n x ON x.seed = sd.entity_id JOIN r ON r.source_id = x.id JOIN n y ON y.seed = x.seed AND y.id = r.target_id GROUP BY ALL)
SELECT question_id, 'entity' AS kind, CAST(row_number() OVER (PARTITION BY question_id ORDER BY s, id) AS INTEGER) AS rank, id || ' ' || label AS item FROM ent QUALIFY rank <= 20
UNION ALL SELECT question_id, 'relationship', CAST(row_number() OVER (PARTITION BY question_id ORDER BY s, source_id, target_id, label) AS INTEGER) AS rank, source_id || ' ' || label || ' ' || target_id FROM rel QUALIFY rank <= 40
UNION ALL SELECT question_id, 'text', CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER), text FROM hit JOIN documents ON doc_id = id WHERE text IS NOT NULL"""


@query(_LOCAL)
def local_retrieve_context(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = _vectors(spark, d).withColumnRenamed("id", "chunk_id").join(docs, "chunk_id", "left").withColumns({"def_name": F.lit(None).cast("string"), "chunk_index": F.lit(0)})
    asked = _questions(spark, d).withColumn("question", F.lit("what is near"))
    e, r, t = retrieval.local_retrieve(asked, chunks, star.links(spark, d), star.entities(spark, d), _relationships(spark, d))
    row = lambda df, kind, item: df.select("question_id", F.lit(kind).alias("kind"), F.col("rank"), item.alias("item"))
    return (
        row(e, "entity", F.concat_ws(" ", "id", "name"))
        .union(row(r, "relationship", F.concat_ws(" ", "source_id", "label", "target_id")))
        .union(row(t, "text", F.col("text")))
    )


@query("""SELECT source AS def_name, CAST(doc_id AS BIGINT) AS chunk_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS n FROM documents QUALIFY n <= 50""")
def def_name_lookup(spark, d):
    defs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("def_"), F.col("source")).alias("def_name"), F.col("doc_id").alias("chunk_index"), "text")
    asked = defs.select("def_name").distinct().select(F.substring("def_name", 5, 99).alias("question_id"), F.concat(F.lit("where is "), "def_name", F.lit(" used, "), "def_name", F.lit("?")).alias("question"))
    found = retrieval.definition_lookup(asked, defs)
    return found.select(F.col("question_id").alias("def_name"), "chunk_id", F.row_number().over(Window.partitionBy("question_id").orderBy("chunk_index")).alias("n"))


@query(r"""WITH x AS (SELECT doc_id, replace(text, ' ', '_') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS i FROM x)
SELECT doc_id, count(DISTINCT i) AS n FROM w WHERE regexp_full_match(i, '[A-Za-z_][A-Za-z0-9_]*') AND (contains(i, '_') OR regexp_matches(i, '[a-z][A-Z]')) GROUP BY 1""")
def identifier_extract(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.size(tx.identifiers(F.translate("text", " ", "_"))).cast("long").alias("n")).filter("n > 0")


@query(r"""WITH q AS (SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS id, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark
  UNION ALL SELECT 'l' || i, x FROM (VALUES (1, 'what does main do'), (2, 'summarize notes.md'), (3, 'Overall themes?'), (4, 'open Store.TSX')) v(i, x))
SELECT id, CASE WHEN regexp_matches(lower(text), '\b[\w-]+\.(?:md|py|tsx?|jsx?|json|ya?ml|toml|go|rs|txt)\b') THEN 'local'
  WHEN list_has_any(regexp_extract_all(lower(text), '[a-z]+'), ['theme','themes','overview','summarize','summary','main','overall','across','everything','codebase']) THEN 'global' ELSE 'local' END AS route FROM q""")
def router_heuristic(spark, d):
    own = spark.createDataFrame([("l1", "what does main do"), ("l2", "summarize notes.md"), ("l3", "Overall themes?"), ("l4", "open Store.TSX")], "id string, text string")
    talk = read(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    bench = read(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    return talk.union(bench).union(own).select("id", tx.heuristic_route(F.col("text")).alias("route"))


@query("""WITH t AS (SELECT source, doc_id, sum(length(text)) OVER w AS total, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id FROM t WHERE n = 1 OR total <= 10000""")
def prompt_prefix_cap(spark, d):
    docs = read(spark, d, "documents").select("source", F.col("doc_id").alias("rank"), "text")
    return retrieval.capped_texts(docs, "source").select("source", F.col("rank").alias("doc_id"))


@query("""SELECT source || '/' || doc_id || '.txt' AS filepath, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents
UNION ALL SELECT 'gone/' || n_nationkey, 'stale' FROM nation""")
def fingerprint_change_detection(spark, d):
    now = _files(spark, d)
    before = now.filter("doc_id % 10 <> 0").select("filepath", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    gone = read(spark, d, "nation").select(F.concat(F.lit("gone/"), F.col("n_nationkey").cast("string")).alias("filepath"), F.lit("x").alias("sha256"))
    return incremental.detect_changes(now, before.unionByName(gone))


@query("SELECT CAST(user_id AS VARCHAR) AS filepath, arg_max(event_type, (epoch_us(ts), event_id)) AS sha256, max(epoch_us(ts)) AS updated_at FROM events GROUP BY 1")
def dedupe_latest_fingerprint(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("user_id").cast("string").alias("filepath"), F.col("event_type").alias("sha256"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("updated_at"))
    return incremental.latest_fingerprints(log).withColumn("updated_at", F.col("updated_at.us"))


@query(r"""SELECT page_id, regexp_extract(lower(url), '[^/](\.[^./]+)$', 1) AS suffix, starts_with(url, 'http://') AS below,
  coalesce(regexp_matches(url, '(^|/)en(/|$)'), false) AS ignored, strlen(html) <= 4000 AS small FROM pages""")
def size_and_extension_filter(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", files.suffix(F.col("url")).alias("suffix"), files.under(F.col("url"), ["http:/"]).alias("below"), files.ignored(F.col("url"), ["en"]).alias("ignored"), (F.octet_length("html") <= 4000).alias("small"))


@query("""WITH u AS (SELECT conv_id, regexp_replace(arg_max(text, turn) FILTER (role = 'user'), '^\\s+|\\s+$', '', 'g') AS q, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1)
SELECT conv_id, q AS question, CASE WHEN n = 0 THEN 'no_user' WHEN coalesce(length(q), 0) = 0 THEN 'empty' WHEN length(q) > 300 THEN 'too_long' ELSE 'ok' END AS status FROM u""".replace("\\\\", "\\"))
def chat_latest_user_question(spark, d):
    return chat.latest_questions(read(spark, d, "conversations"), replace(DEFAULT, max_question_chars=300))


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations),
f AS (SELECT conv_id, turn, CASE WHEN size > 600 THEN 'message' ELSE 'total' END AS error FROM s WHERE size > 600 OR total > 1500)
SELECT conv_id, arg_min(error, turn) AS error, min(turn) AS turn FROM f GROUP BY 1""")
def chat_validation_first_error(spark, d):
    return chat.first_errors(read(spark, d, "conversations"), replace(DEFAULT, max_message_chars=600, max_total_chars=1500, max_question_chars=300))


@query("""SELECT conv_id, turn, '{"object":"chat.completion","model":"m","choices":[{"index":0,"message":{"role":"assistant","content":' || to_json(CASE WHEN text = '' THEN 'No answer.' ELSE text END) || '},"finish_reason":"stop"}]}' AS body FROM conversations WHERE role = 'assistant'""")
def chat_response_json(spark, d):
    rows = read(spark, d, "conversations").filter("role = 'assistant'").select(F.struct("conv_id", "turn").alias("conv_id"), F.col("text").alias("answer"))
    return chat.responses(rows, "m").select("conv_id.conv_id", "conv_id.turn", "body")


@query("""SELECT role, length(text) BETWEEN 1 AND 100 AND role IN ('system', 'user', 'assistant') AND turn <= 200 AS valid, count(*) AS n FROM conversations GROUP BY ALL""")
def chat_request_fields(spark, d):
    c = read(spark, d, "conversations")
    rows = c.select("role", F.col("text").alias("model"), F.greatest(F.col("turn"), F.lit(1)).alias("n_messages"), F.array("role").alias("roles"), F.lit("auto").alias("mode"))
    return chat.request_fields(rows, replace(DEFAULT, max_model_name_chars=100)).groupBy("role", "valid").agg(F.count("*").alias("n"))


def _lines(spark, d):
    rows = read(spark, d, "conversations")
    return rows.select(F.col("conv_id").cast("string").alias("filepath"), F.col("turn").cast("int").alias("chunk_index"), "text")


@query("""WITH RECURSIVE c AS (SELECT CAST(conv_id AS VARCHAR) AS f, CAST(turn AS INTEGER) AS t, length(text) // 4 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
p AS (SELECT f, t, k, n, 0 AS b, k AS held FROM c WHERE n = 1
      UNION ALL SELECT c.f, c.t, c.k, c.n, CASE WHEN p.held + c.k > 150 THEN p.b + 1 ELSE p.b END, CASE WHEN p.held + c.k > 150 THEN c.k ELSE p.held + c.k END FROM p JOIN c ON c.f = p.f AND c.n = p.n + 1)
SELECT f AS filepath, t AS chunk_index, CAST(k AS BIGINT) AS tokens, b AS batch_index FROM p""")
def extraction_batch_packing(spark, d):
    return extraction.pack_batches(_lines(spark, d), 150)


def _answers(spark, d):
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    entity = lambda n, t, x: F.struct(n.alias("name"), t.alias("type"), x.alias("description"))
    own = F.array(entity(F.concat(F.lit(" "), "s_name"), F.lit(None).cast("string"), F.lit("a")), entity(F.upper("s_name"), F.lit("SUPPLIER"), F.lit("longer")), entity(F.col("n_name"), F.lit("NATION"), F.lit("")))
    edge = lambda s, t, x: F.struct(s.alias("source"), t.alias("target"), F.lit(x).alias("label"))
    edges = F.array(edge(F.col("s_name"), F.col("n_name"), "in"), edge(F.col("s_name"), F.col("n_name"), "in"), edge(F.col("s_name"), F.lit("Nowhere"), "in"))
    body = F.to_json(F.struct(own.alias("entities"), edges.alias("relationships")), {"ignoreNullFields": "false"})
    odd = F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("{} "), F.regexp_replace(body, "null", "None"))).when(F.col("s_suppkey") % 3 == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(body)
    return s.select(F.col("s_suppkey").cast("string").alias("filepath"), F.lit(0).alias("batch_index"), odd.alias("result"))


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS filepath, {_SLUG.format('s_name')} AS id, s_name AS name, 'SUPPLIER' AS type, 'longer' AS description FROM supplier
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), {_SLUG.format('n_name')}, n_name, 'NATION', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def extraction_json_parse(spark, d):
    return extraction.normal_entities(extraction.parse_answers(_answers(spark, d)))


@query(f"""SELECT {_SLUG.format('s_name')} AS source_id, {_SLUG.format('n_name')} AS target_id, 'in' AS label, CAST(s_suppkey AS VARCHAR) AS source_doc FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (VALUES (1), (2)) v(i) ON true""")
def extraction_relationships(spark, d):
    parsed = extraction.parse_answers(_answers(spark, d))
    return extraction.normal_relationships(parsed, extraction.normal_entities(parsed))


_LINES = "l AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


@query(rf"""WITH {_LINES}, n AS (SELECT DISTINCT doc_id, regexp_extract(line, '^([A-Za-z]{{3,}})', 1) AS name FROM l),
w AS (SELECT doc_id, i, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+') AS words FROM l)
SELECT DISTINCT doc_id || ':' || i AS chunk_id, lower(name) AS entity_id FROM w JOIN n USING (doc_id) WHERE name <> '' AND list_contains(words, lower(name))""")
def entity_chunk_linking(spark, d):
    """Lines as chunks of their document; its entities are the words its lines begin with."""
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("filepath"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    chunks = lines.select(F.concat_ws(":", "filepath", F.col("i") + 1).alias("chunk_id"), "filepath", "text")
    names = lines.select("filepath", F.regexp_extract("text", "^([A-Za-z]{3,})", 1).alias("name")).filter("name <> ''").distinct()
    return extraction.link_chunks(chunks, names.select("filepath", F.lower("name").alias("id"), "name"))


@query("""WITH a AS (SELECT conv_id, turn, role FROM conversations WHERE turn % 2 = 0), b AS (SELECT DISTINCT conv_id, turn, role FROM conversations)
SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS chunk_id, role AS entity_id FROM a UNION ALL
SELECT CAST(conv_id AS VARCHAR) || '/' || turn, role FROM b WHERE (conv_id, turn, role) NOT IN (SELECT conv_id, turn, role FROM a)""")
def link_insert_or_ignore(spark, d):
    rows = read(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("role").alias("entity_id"), "turn")
    return extraction.link_append(rows.filter("turn % 2 = 0").drop("turn"), rows.drop("turn").unionByName(rows.drop("turn")))


def _prompt(lead: str) -> str:
    return "'" + lead.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"SELECT CAST(conv_id AS VARCHAR) AS filepath, CAST(turn AS INTEGER) AS batch_index, {_prompt(extraction.EXTRACTION_PROMPT)} || text AS prompt FROM conversations")
def extraction_prompts(spark, d):
    batches = _lines(spark, d).withColumnRenamed("chunk_index", "batch_index")
    return extraction.extraction_prompts(batches).select("filepath", "batch_index", "prompt")


@query("""SELECT CAST(user_id AS VARCHAR) AS filepath, count(*) AS batches, max(event_id) AS last FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0 GROUP BY 1""")
def extraction_cache(spark, d):
    """Answers put in (later ones of a batch win), those of some files cleared, and read as a map by file."""
    e = read(spark, d, "events").filter("event_type <> 'error'").select(F.col("user_id").cast("string").alias("filepath"), F.lit("h").alias("sha256"), F.col("event_id").cast("int").alias("batch_index"), F.col("event_type").alias("result"), "user_id")
    cache = extraction.cache_put(e.drop("user_id"), e.drop("user_id").filter("batch_index % 2 = 0"))
    kept = extraction.cache_clear(cache, e.filter("user_id % 3 = 0").select("filepath").distinct())
    return extraction.cached_answers(kept).select("filepath", F.size("answers").cast("long").alias("batches"), F.array_max(F.map_keys("answers")).cast("long").alias("last"))


@query()
def chunk_text(spark, d):
    return chunking.chunk_documents(_files(spark, d))


@query()
def chunk_markdown(spark, d):
    docs = _files(spark, d).select(F.regexp_replace("filepath", "txt$", "md").alias("filepath"), F.regexp_replace("text", "\n", "\n\n# ").alias("text"))
    return chunking.chunk_documents(docs)


@query()
def chunk_python(spark, d):
    body = F.concat(F.lit("import os\n\ndef f"), F.col("doc_id").cast("string"), F.lit("():\n    return '''"), F.translate("text", "'\\", ""), F.lit("'''\n"))
    return chunking.chunk_documents(_files(spark, d).select(F.regexp_replace("filepath", "txt$", "py").alias("filepath"), body.alias("text")))


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '\s+', chr(10) || '## ', 'g') AS t FROM documents WHERE length(text) > 0)),
s AS (SELECT doc_id, i, line, sum(CASE WHEN i > 1 AND regexp_matches(line, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM x),
t AS (SELECT doc_id, section, trim(string_agg(line, chr(10) ORDER BY i)) AS chunk FROM s GROUP BY ALL)
SELECT doc_id || '.md' AS filepath, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS chunk_index, chunk AS text FROM t WHERE chunk <> ''""")
def markdown_sections(spark, d):
    """The chunker on documents whose words are all headed: as no section is too long, its chunks are the sections."""
    docs = read(spark, d, "documents").filter("length(text) > 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filepath"), F.regexp_replace("text", "[\\t\\n\\f\\r ]+", "\n## ").alias("text"))
    return chunking.chunk_documents(docs, replace(DEFAULT, max_chunk_chars=1_000_000)).select("filepath", "chunk_index", "text")


@query()
def louvain_communities(spark, d):
    return community.louvain(graph.undirected(graph.simple_graph(_relationships(spark, d))))


@query(ORACLE_SQL["member_hash"].replace("SELECT l.community, sha256(", """, m AS (SELECT community, count(*) AS n, list(name ORDER BY id)[1:10] AS names FROM e WHERE community IS NOT NULL GROUP BY 1)
SELECT l.community AS id, m.n || ' entities: ' || array_to_string(m.names, ', ') AS summary, 'summarised' AS status, sha256(""").replace("USING (community)", "USING (community) JOIN m ON m.community = l.community"))
def community_summaries(spark, d):
    known = spark.createDataFrame([], "id int, member_hash string, summary string")
    return community.refresh_summaries(star.entities(spark, d), _relationships(spark, d), known, community.extractive_summary)


@query(STAR + f""", m AS (SELECT community, string_agg('- ' || name || ' (' || coalesce(type, 'unknown') || '): ' || coalesce(description, ''), chr(10) ORDER BY id) AS lines FROM e WHERE community IS NOT NULL GROUP BY 1),
i AS (SELECT x.community, string_agg('- ' || source_id || ' --[' || label || ']--> ' || target_id, chr(10) ORDER BY source_id, target_id, label) AS edges FROM r JOIN e x ON x.id = source_id JOIN e y ON y.id = target_id AND x.community = y.community GROUP BY 1)
SELECT m.community AS id, {_prompt(community.SUMMARY_PROMPT)} || lines || coalesce(chr(10) || chr(10) || 'Connections:' || chr(10) || edges, '') AS prompt FROM m LEFT JOIN i USING (community)""")
def summary_prompts(spark, d):
    e = star.entities(spark, d)
    return community.summary_prompts(e, _relationships(spark, d), community.active_communities(e))


@query(STAR + """, c AS (SELECT CAST(label AS INTEGER) AS id, list_sort(list('"v' || vec_id || '"')) AS ids FROM embeddings GROUP BY 1)
SELECT id, len(ids) AS members, id IN (SELECT community FROM e WHERE community IS NOT NULL) AS active FROM c""")
def community_lookup(spark, d):
    """Communities with their members read from JSON, and whether any entity is in them."""
    held = read(spark, d, "embeddings").groupBy(F.col("label").cast("int").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.concat(F.lit("v"), F.col("vec_id").cast("string"))))).alias("entity_ids"))
    active = community.active_communities(star.entities(spark, d)).withColumn("active", F.lit(True))
    return community.with_members(held).join(active, "id", "left").select("id", F.size("entity_ids").cast("long").alias("members"), F.coalesce("active", F.lit(False)).alias("active"))


@query()
def community_summaries_by_model(spark, d):
    """Summaries by the offline model, with their vectors and status."""
    known = spark.createDataFrame([], indexing.SCHEMAS["communities"])
    return community.summarise_all(star.entities(spark, d), staged(_relationships(spark, d), "relationships"), known, models.OfflineModel(), models.HashingEmbedder(64))


@query("""SELECT source || '/' || doc_id || '.txt' AS filepath, CASE WHEN regexp_full_match(coalesce(text, ''), '\\s*') THEN 'skipped' ELSE 'indexed' END AS outcome FROM documents""".replace("\\\\", "\\"))
def index_run(spark, d):
    """A whole index run into an empty store, with the offline models: what became of each file."""
    store = indexing.open_store(spark, f"{shared_dir(spark)}/lattica/store-{uuid.uuid4().hex}")
    return indexing.index(store, _files(spark, d).select("filepath", "sha256", F.coalesce("text", F.lit("")).alias("text")), models.HashingEmbedder(64), models.OfflineModel())


@query("""SELECT conv_id, max(turn) AS turn, CASE WHEN arg_max(text, turn) = '' THEN NULL ELSE arg_max(text, turn) END AS answer FROM (SELECT conv_id, turn, regexp_replace(regexp_extract('q' || chr(10) || chr(10) || replace(text, chr(10), ' '), '[^\\n]*$'), '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE role = 'user') GROUP BY 1""".replace("\\\\", "\\"))
def ask_offline(spark, d):
    """The last user turn of each conversation, answered by the offline model (which gives back the last paragraph)."""
    last = read(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))
    prompts = last.select(F.struct("conv_id", "turn").alias("question_id"), F.concat(F.lit("q\n\n"), F.translate("text", "\n", " ")).alias("prompt"))
    return generation.ask(prompts, models.OfflineModel()).select("question_id.conv_id", "question_id.turn", F.nullif("answer", F.lit("")).alias("answer"))


@query("""SELECT page_id, regexp_full_match(url, '.*[^/]\\.(html?|php|txt)') AND NOT coalesce(regexp_matches(url, '(^|/)en(/|$)'), false) AS ok FROM pages""".replace("\\\\", "\\"))
def indexable_path(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", files.indexable(F.col("url"), ["html", "htm", "php", "txt"], ["en"]).alias("ok"))


@query("""SELECT page_id FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0 AND starts_with(url, 'http://') AND strlen(html) <= 4000 AND regexp_matches(lower(url), '[^/]\\.[^./]+$') AND regexp_extract(lower(url), '[^/](\\.[^./]+)$', 1) IN ('.html', '.com', '.org', '.net', '.example')""".replace("\\\\", "\\"))
def safe_file_predicate(spark, d):
    """Pages as a listing: every seventh stands for a symbolic link, every fifth for no regular file."""
    p = read(spark, d, "pages")
    listing = p.select("page_id", F.col("url").alias("path"), F.octet_length("html").alias("length"), (F.col("page_id") % 7 == 0).alias("is_link"), (F.col("page_id") % 5 != 0).alias("is_file"))
    return files.safe(listing, ["http:/"], ["html", "com", "org", "net", "example"], 4000).select("page_id")


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_id % 3 <> 0 THEN '10.' || event_id % 200 || '.0.7' ELSE '192.0.2.' || user_id % 200 END AS address,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type || event_id END AS token FROM events""")
def request_scalars(spark, d):
    """Clients' addresses behind proxies of which some are trusted, and their tokens."""
    e = read(spark, d, "events")
    n = lambda c, k: (F.col(c) % k).cast("string")
    peer = F.concat(F.lit("192.0.2."), n("user_id", 200))
    header = F.when(F.col("event_id") % 3 == 0, "unknown, 1.1.1.1").otherwise(F.concat(F.lit(" 10."), n("event_id", 200), F.lit(".0.7, 1.1.1.1")))
    rows = e.select("event_id", "user_id", peer.alias("peer"), header.alias("header"), F.when(F.col("event_id") % 4 == 0, F.lit("Basic x")).otherwise(F.concat(F.lit("Bearer "), "event_type", F.col("event_id").cast("string"))).alias("auth"))
    trusted = [f"192.0.2.{k}" for k in range(0, 200, 2)]
    return rows.select("event_id", network.client_address(F.col("peer"), F.col("header"), trusted).alias("address"), network.bearer_token(F.col("auth")).alias("token"))


@query("""SELECT DISTINCT event_type AS model, '{"id":' || to_json(event_type) || ',"object":"model","owned_by":"local"}' AS body FROM events""")
def model_list_entries(spark, d):
    return chat.model_entries(read(spark, d, "events").select(F.col("event_type").alias("model")).distinct())


_DAY = 86_400_000_000


@query(f"""WITH RECURSIVE q AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
s AS (SELECT key, t, id, n, true AS accepted, [t] AS kept FROM q WHERE n = 1
  UNION ALL SELECT key, t, id, n, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END
  FROM (SELECT q.*, list_filter(s.kept, lambda x: q.t - x < {_DAY}) AS live FROM s JOIN q ON q.key = s.key AND q.n = s.n + 1))
SELECT key, t AS "at", id, accepted FROM s""")
def rate_limit_sliding_window(spark, d):
    e = read(spark, d, "events")
    requests = e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return limiter.rate_limit(requests, _DAY, 3)


@query("""WITH RECURSIVE q AS (SELECT user_id // 15 AS key, epoch_us(ts) // 1000 AS t, event_id AS id, row_number() OVER (PARTITION BY user_id // 15 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT key, t, id, n, true AS accepted, [t] AS kept FROM q WHERE n = 1
  UNION ALL SELECT key, t, id, n, len(live) < 10, CASE WHEN len(live) < 10 THEN list_append(live, t) ELSE live END
  FROM (SELECT q.*, list_filter(s.kept, lambda x: q.t - x < 60000000) AS live FROM s JOIN q ON q.key = s.key AND q.n = s.n + 1))
SELECT key, t AS "at", id, accepted FROM s""")
def rate_limit_logins(spark, d):
    """Attempts of groups of users, on a clock that runs a thousand times as fast."""
    e = read(spark, d, "events")
    return limiter.login_limit(e.select(F.expr("user_id div 15").alias("key"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("at"), F.col("event_id").alias("id")))


@query("SELECT c_name AS username, CAST(min(o_orderkey) AS DOUBLE) AS created_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def user_list(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").cast("double").alias("created_at"))
    return limiter.list_users(read(spark, d, "customer").join(o, "c_custkey").select(F.col("c_name").alias("username"), "created_at"))


_SESSIONS = "WITH s AS (SELECT event_id AS token, 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS username, epoch(ts) + 8 * 3600 AS expires_at FROM events WHERE event_type = 'signup')"
_NOW = 1705276800.0


def _sessions(spark, d):
    e = read(spark, d, "events").filter("event_type = 'signup'")
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    return limiter.new_sessions(e.select(F.col("event_id").alias("token"), name.alias("username"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 8)


@query(f"{_SESSIONS} SELECT token, username FROM s WHERE expires_at > {_NOW} AND username IN (SELECT c_name FROM customer)")
def session_validate(spark, d):
    return limiter.valid_sessions(_sessions(spark, d), read(spark, d, "customer").select(F.col("c_name").alias("username")), _NOW)


@query(f"{_SESSIONS} SELECT token FROM s WHERE NOT expires_at <= {_NOW}")
def session_purge(spark, d):
    return limiter.purge(_sessions(spark, d), _NOW).select("token")


@query("""SELECT CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 10 <> 0 AND doc_id % 7 <> 0 OR length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) = 0 THEN 'skipped' ELSE 'indexed' END AS outcome, count(*) AS count FROM documents GROUP BY 1""")
def ingest_status_counts(spark, d):
    now = _files(spark, d)
    before = now.filter("doc_id % 10 <> 0").select("filepath", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    chunks = now.filter(F.length(F.regexp_replace("text", r"\s", "")) > 0)
    outcome = incremental.file_status(now, incremental.detect_changes(now, before), chunks, now.filter("doc_id % 11 = 0"))
    return incremental.status_counts(outcome)


@query("SELECT doc_id, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 6000) AS ready FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0".replace("\\\\", "\\"))
def embedding_prepare(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", tx.prepared_for_embedding(F.col("text"), DEFAULT.max_embed_chars).alias("ready")).filter("ready is not null")
