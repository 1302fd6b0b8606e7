"""Functions and operators on small cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lattica.config import DEFAULT, EngineConfig
from lattica.functions import text as tx
from lattica.functions.vector import cosine_topk
from lattica.operators import chat, community, extraction, graph, incremental, retrieval
from lattica.operators.chunking import Splitter
from lattica.sources import files
from lattica.streaming import limiter


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column(F.col("v"))).collect()]


def test_slug(spark):
    assert values(spark, tx.slug, ["MyEntity", "fingerprint store", "rag.embed", "  _hello_  ", "foo--bar  baz", "é"]) == ["myentity", "fingerprint_store", "rag_embed", "hello", "foo_bar_baz", ""]


def test_identifiers(spark):
    assert values(spark, tx.identifiers, ["use _parse_x and GraphStore", "HTTPServer iPhone __init__ main", "plain words", "a_b a_b c_d"]) == [["_parse_x", "GraphStore"], ["iPhone", "__init__"], [], ["a_b", "c_d"]]


def test_route(spark):
    asked = ["what does main do", "summarize notes.md", "What are the themes?", "where is parse defined"]
    assert values(spark, tx.heuristic_route, asked) == ["global", "local", "global", "local"]


def test_none_and_json(spark):
    assert [tx.none_as_null(t) for t in ("[None, None, {}]", '{"a": None}', '"None"', "[ None\n]", "Nonesuch", "[None")] == ["[null, null, {}]", '{"a": null}', '"None"', "[ null\n]", "Nonesuch", "[None"]
    good = {"entities": [], "relationships": []}
    for text in ('{"entities": [], "relationships": []}', '{} {"entities": [], "relationships": []}', 'Sure: {"entities": [], "relationships": []} ok'):
        assert tx.recover_json(text) == good
    assert tx.recover_json("garbage") is None and tx.recover_json(None) is None
    assert tx.recover_json('Here {"entities": [None, None]}') == {"entities": [None, None]}
    assert tx.recover_json('{"a": "None"}') == {"a": "None"}


def test_answers_of_other_shapes(spark):
    rows = [("f", i, t) for i, t in enumerate(["null", "[1]", '{"entities": null, "relationships": 5}', '{"entities": [null, {"name": 7}]}', None])]
    got = extraction.parse_answers(spark.createDataFrame(rows, "filepath string, batch_index int, result string")).orderBy("batch_index").collect()
    assert [len(r.entities) for r in got] == [0, 0, 0, 1, 0] and got[3].entities[0]["name"] == "7"
    assert [r.had_failure for r in got] == [False] * 4 + [True]


def test_mentions(spark):
    rows = [("use Alpha now", "alpha", True), ("Catalog", "Cat", False), ("use C++ now", "C++", False), ("École", "école", True), ("a.b", "a.b", True), ("axb", "a.b", False)]
    df = spark.createDataFrame(rows, "t string, n string, e boolean")
    assert df.filter(tx.mentions(F.col("t"), F.col("n")) != F.col("e")).count() == 0


def test_merge_entities(spark):
    rows = [("Foo", None, "x", 1), ("foo!", "CLASS", "longer", 2), ("FOO", "ENUM", "yy", 3), ("??", "X", "y", 4)]
    got = graph.merge_entities(spark.createDataFrame(rows, "name string, type string, description string, seq long")).collect()
    assert [tuple(r) for r in got] == [("foo", "Foo", "CLASS", "longer")]
    base = spark.createDataFrame([("foo", "Old", None, "longer")], "id string, name string, type string, description string")
    got = graph.merge_entities(spark.createDataFrame(rows, "name string, type string, description string, seq long"), base).first()
    assert (got.name, got.type, got.description) == ("Old", "CLASS", "longer")


def test_relationship_weights_and_gc(spark):
    seen = spark.createDataFrame([("a", "b", "calls", "f"), ("a", "b", "calls", "f"), ("b", "c", "calls", "g")], "source_id string, target_id string, label string, source_doc string")
    rel = graph.merge_relationships(seen)
    assert {(r.source_id, r.weight) for r in rel.collect()} == {("a", 2.0), ("b", 1.0)}
    assert graph.merge_relationships(seen, rel).filter("source_id = 'a'").first().weight == 4.0
    chunks = spark.createDataFrame([("1", "f"), ("2", "g")], "chunk_id string, filepath string")
    links = spark.createDataFrame([("1", "a"), ("2", "d")], "chunk_id string, entity_id string")
    rel2, chunks2, links2 = graph.delete_files(rel, chunks, links, spark.createDataFrame([("f",)], "filepath string"))
    entities = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert {r.id for r in graph.gc_orphans(entities, rel2, links2).collect()} == {"b", "c", "d"} and chunks2.count() == 1


def test_neighborhood_of_a_lone_node(spark):
    e = spark.createDataFrame([("a", "A", None, None), ("z", "Z", None, None)], "id string, name string, type string, description string")
    r = spark.createDataFrame([("a", "b", "l", "f", 1.0)], "source_id string, target_id string, label string, source_doc string, weight double")
    nodes = graph.k_hop(graph.simple_graph(r), spark.createDataFrame([("z",), ("?",)], "seed string"), 2)
    got, rel = graph.neighborhoods(e, r, nodes)
    assert [(x.seed, x.id) for x in got.collect()] == [("z", "z")] and rel.count() == 0


def test_member_hash(spark):
    e = spark.createDataFrame([("a", "n", "T", "d", 0)], "id string, name string, type string, description string, community int")
    r = spark.createDataFrame([], "source_id string, target_id string, label string, source_doc string, weight double")
    assert graph.member_hashes(e, r).first().member_hash == "dc0098c6a33a783b771ae400bbb483f813f2253ed3c1dd149dbdda437cf7ada3"
    first = community.refresh_summaries(e, r, spark.createDataFrame([], "id int, member_hash string, summary string"), community.extractive_summary)
    assert [x.status for x in first.collect()] == ["summarised"]
    known = first.select("id", "member_hash", "summary")
    assert [x.status for x in community.refresh_summaries(e, r, known, community.extractive_summary).collect()] == ["kept"]
    assert [x.status for x in community.refresh_summaries(e, r, known, community.extractive_summary, force=True).collect()] == ["summarised"]


def test_two_cliques():
    edges = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 0.1)]
    found = community.louvain_local(edges, sum(w for *_, w in edges))
    assert {n: c for n, c in found.items()} == {**{n: "a" for n in "abcd"}, **{n: "w" for n in "wxyz"}}


def test_batches(spark):
    rows = [("f", i, "x" * 4 * n) for i, n in enumerate([3000, 1000, 0, 4000, 2])]
    got = extraction.pack_batches(spark.createDataFrame(rows, "filepath string, chunk_index int, text string"), 4000).orderBy("chunk_index").collect()
    assert [r.batch_index for r in got] == [0, 0, 0, 1, 2]


def small(size, overlap):
    return Splitter(EngineConfig(chunk_size=size, chunk_overlap=overlap, max_chunk_chars=max(size, 20)))


def test_splitter():
    s = small(10, 4)
    assert s.text("aaa bbb ccc ddd") == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert s.text("abcd 0123456789") == ["abcd", "abcd 0123456789"]
    assert Splitter().text("a\n\n\n\nb") == ["a\n\nb"] and Splitter().text("  \n") == []
    long = "word " * 3000
    assert all(len(c) <= 602 for c in Splitter().text(long)) and len(Splitter().text("x" * 1200)) == 3


def test_python_chunks():
    s = Splitter()
    assert s.document("a.py", "import os\n\ndef f():\n    return 1\n") == [("def f():\n    return 1", "f")]
    names = [n for _, n in s.document("a.py", '"""doc"""\nX = 1\nasync def g(): pass\nclass K: pass\n')]
    assert names == [None, None, "g", "K"]
    assert s.document("a.py", "@d\nclass K: pass\n") == [("@d", None), ("class K: pass", "K")]
    assert s.document("a.py", "def broken(:\n") == [("def broken(:", None)] and s.document("a.py", "import os\n") == [("import os", None)]
    big = "def f():\n" + "    x = 'some text in a line'\n" * 300
    assert len(found := s.document("a.py", big)) > 1 and {n for _, n in found} == {"f"}


def test_markdown_chunks():
    s = small(10, 4)
    assert s.document("a.md", "# A\none\n## B\ntwo") == [("# A\none", None), ("## B\ntwo", None)]
    assert [c for c, _ in s.document("a.MD", "# A\n\nfirst text here\n\nsecond")] == ["# A\n\nfirst text here", "second"]


def test_paths(spark):
    rows = ["a/x.PY", "a/.env", "a/b.tar.gz", "node_modules/x.py", "src/gen/x.py", "src/x.pyc"]
    assert values(spark, files.suffix, rows) == [".py", "", ".gz", ".py", ".py", ".pyc"]
    assert values(spark, lambda c: files.ignored(c, ["node_modules", "*.pyc", "src/gen"]), rows) == [False, False, False, True, True, True]
    assert values(spark, lambda c: files.under(c, ["src", "a/"]), ["src", "src/x", "srcs/x", "a/b"]) == [True, True, False, True]


def test_index_settings():
    s = files.index_settings({"index_paths": ["/x", {"path": "/y", "recursive": False, "exclude_dirs": "venv"}], "allowed_extensions": ["MD"]})
    assert s.paths[1].exclude_dirs == {"venv"} and not s.paths[1].recursive and s.allowed_extensions == {".md"}
    for bad in ({}, {"index_paths": []}, {"index_paths": [{"path": "/x", "recursive": "true"}]}, {"index_paths": [{"recursive": True}]}):
        with pytest.raises(ValueError):
            files.index_settings(bad)


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "sub" / "b.py").write_text("x")
    (tmp_path / "c.bin").write_text("x")
    (tmp_path / "big.md").write_text("x" * 100)
    scan = lambda **k: {r.filepath.rsplit("/", 1)[1]: r for r in files.decoded(files.scan(spark, files.index_settings({"index_paths": [{"path": str(tmp_path), **k}, "/no/such/folder"]}), 50)).collect()}
    assert set(scan()) == {"a.md", "b.py"} and scan()["a.md"].text == "ok  end"
    assert set(scan(recursive=False)) == {"a.md"} and set(scan(exclude_dirs=["sub"])) == {"a.md"}


def test_config():
    for bad in (dict(chunk_size=0), dict(chunk_overlap=500), dict(max_question_chars=200_000), dict(max_message_chars=200_000), dict(chunk_overlap=-1)):
        with pytest.raises(ValueError):
            replace(DEFAULT, **bad)


def test_limiter(spark):
    assert limiter.decide([0, 10, 20, 60, 65, 70], 60, 2)[0] == [True, True, False, True, False, True]
    rows = [("k", t, i) for i, t in enumerate([0, 10, 20, 60, 65, 70])] + [("m", 0, 9)]
    got = limiter.rate_limit(spark.createDataFrame(rows, "key string, at long, id long"), 60, 2).orderBy("key", "id").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False, True, True]


def test_limiter_stream(spark, tmp_path):
    rows = [("k", t, i) for i, t in enumerate([0, 10, 20, 60, 65, 70])]
    spark.createDataFrame(rows, "key string, at long, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.rate_limit_stream(spark.readStream.schema("key string, at long, id long").parquet(str(tmp_path / "in")), 60, 2)
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.accepted for r in spark.table("limited").orderBy("id").collect()] == [True, True, False, True, False, True]


def test_chat(spark):
    rows = [("a", 0, "user", "12345"), ("a", 1, "user", "1234"), ("b", 0, "system", "x"), ("c", 0, "user", "  ")]
    m = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    tight = replace(DEFAULT, max_message_chars=5, max_total_chars=8, max_question_chars=8)
    assert [tuple(r) for r in chat.first_errors(m, tight).collect()] == [("a", "total", 1)]
    got = {r.conv_id: r.status for r in chat.latest_questions(m, tight).collect()}
    assert got == {"a": "ok", "b": "no_user", "c": "empty"}


def test_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None)], "id long, vector array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.0])], "question_id string, vector array<double>")
    assert [(r.id, r.score) for r in cosine_topk(asked, base, 9).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert [r.id for r in cosine_topk(asked, base, 1, descending_ids=True).collect()] == [3]
    assert cosine_topk(asked.filter("false"), base, 1).count() == 0


def test_prompt_cap_and_plan(spark):
    t = spark.createDataFrame([("q", 1, "x" * 6000), ("q", 2, "y" * 6000), ("q", 3, "z" * 100), ("p", 1, "w" * 15000), ("p", 2, "v")], "question_id string, rank int, text string")
    assert {(r.question_id, r.rank) for r in retrieval.capped_texts(t, "question_id").collect()} == {("q", 1), ("p", 1)}
    asked = spark.createDataFrame([("q", "overview please"), ("p", "where is x")], "question_id string, question string")
    none = spark.createDataFrame([], "id int, summary string, vector array<double>")
    routed = retrieval.route(asked, retrieval.communities_available(none))
    assert {r.route for r in routed.collect()} == {"local"}
    some = spark.createDataFrame([(True,)], "available boolean")
    routed = retrieval.route(asked, some)
    hits = spark.createDataFrame([("q",), ("p",)], "question_id string")
    assert {r.question_id: r.plan for r in retrieval.plan(routed, "auto", hits).collect()} == {"q": "global", "p": "local"}
    assert {r.plan for r in retrieval.plan(routed, "global", hits.filter("false")).collect()} == {"local"}
    with pytest.raises(ValueError):
        retrieval.plan(routed, "other", hits)


def test_store(spark, tmp_path):
    store = incremental.Store(spark, str(tmp_path), {"a": "x int", "b": "x int"})
    assert store.read("a").count() == 0 and store.versions() == {}
    for n in range(4):
        store.commit({"a": store.read("a").union(spark.createDataFrame([(n,)], "x int")), **({"b": spark.range(3).selectExpr("cast(id as int) as x")} if n == 1 else {})})
    assert sorted(r.x for r in store.read("a").collect()) == [0, 1, 2, 3] and store.read("b").count() == 3
    assert len(list((tmp_path / "a").iterdir())) == 2 and len(list((tmp_path / "b").iterdir())) == 1 and len(store._pointers()) == 2
    (tmp_path / "a" / "half-written").mkdir()  # a run that stopped before its pointer
    assert store.read("a").count() == 4


def test_white_space(spark):
    assert values(spark, tx.stripped, ["\tFoo\n", "\u00a0x y\u2003", "", " \x1f\n"]) == ["Foo", "x y", "", ""]


def test_chat_items(spark):
    """Content as items: texts joined, all values counted, and the first check that fails message by message."""
    rows = [("a", 0, "user", None, [{"type": "text", "text": "hi"}, {"type": "x"}, {"type": "text", "text": "you"}]), ("a", 1, "user", "plain", None), ("b", 0, "user", None, [{"t": "1"}] * 3)]
    m = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, items array<map<string,string>>")
    got = m.select("conv_id", "turn", chat.flat_content(F.col("text"), F.col("items")).alias("t"), chat.message_size(F.col("text"), F.col("items")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("hi  you", 14), ("plain", 5), ("  ", 3)]
    tight = replace(DEFAULT, max_content_items=2, max_message_chars=13, max_total_chars=20, max_question_chars=13)
    assert {tuple(r) for r in chat.first_errors(m, tight, has_items=True).collect()} == {("a", "message", 0), ("b", "items", 0)}
    fields = spark.createDataFrame([("u", "p"), ("", "p"), ("u" * 129, "p"), (None, "p")], "username string, password string")
    assert [r.valid for r in chat.login_fields(fields).collect()] == [True, False, False, False]


def test_server_sent_events(spark):
    import json

    pieces = spark.createDataFrame([("c", 0, "He\"l"), ("c", 1, "lo\n")], "conv_id string, seq long, piece string")
    lines = [r.line for r in chat.stream_chunks(pieces, "m").orderBy("seq").collect()] + [r.line for r in chat.stream_end(pieces.select("conv_id").distinct(), "m").collect()]
    events = [e for line in lines for e in line.split("\n\n") if e]
    assert all(e.startswith("data: ") for e in events) and events[-1] == "data: [DONE]"
    bodies = [json.loads(e[6:]) for e in events[:-1]]
    assert "".join(b["choices"][0]["delta"].get("content", "") for b in bodies) == 'He"llo\n' and bodies[-1]["choices"][0]["finish_reason"] == "stop"
    assert all(b["object"] == "chat.completion.chunk" and b["model"] == "m" for b in bodies)


def test_prompts(spark):
    asked = spark.createDataFrame([("q", "What is A?"), ("p", "And?")], "question_id string, question string")
    e = spark.createDataFrame([("q", 1, "a", "A", "T", "first"), ("q", 2, "b", "B", None, None)], "question_id string, rank int, id string, name string, type string, description string")
    r = spark.createDataFrame([("q", 1, "a", "b", "calls", 1.0), ("q", 2, "a", "z", "uses", 1.0)], "question_id string, rank int, source_id string, target_id string, label string, weight double")
    t = spark.createDataFrame([("q", 1, "one"), ("q", 2, "two")], "question_id string, rank int, text string")
    got = {x.question_id: x.prompt for x in retrieval.local_prompts(asked, e, r, t).collect()}
    assert got["q"] == "Known entities:\n- A (T): first\n- B (unknown): \n\nRelations:\n- A --[calls]--> B\n- A --[uses]--> z\n\nPassages:\none\n\ntwo\n\nQuestion: What is A?"
    assert got["p"] == "Known entities:\n(none)\n\nRelations:\n(none)\n\nPassages:\n(none)\n\nQuestion: And?"
    hits = spark.createDataFrame([("q", 7, "seven", 2), ("q", 3, "three", 1)], "question_id string, id int, summary string, rank int")
    assert [x.prompt for x in retrieval.global_prompts(asked, hits).collect()] == ["Community 3:\nthree\n\nCommunity 7:\nseven\n\nQuestion: What is A?"]


def test_seeds_that_a_capped_answer_needs(spark):
    """Behind a seed whose neighbourhood fills both caps no other seed counts; those before it do."""
    seeds = spark.createDataFrame([("q", s, k + 1) for k, s in enumerate("abc")] + [("p", "a", 1), ("p", "d", 2)], "question_id string, entity_id string, seed_rank int")
    nodes = spark.createDataFrame([("a", "a")] + [("b", f"n{k}") for k in range(41)] + [("c", "c"), ("d", "d")], "seed string, id string")
    entities = spark.createDataFrame([(f"n{k}",) for k in range(20)] + [("a",)], "id string")
    got = {(r.question_id, r.entity_id) for r in retrieval.needed_seeds(seeds, nodes, entities).collect()}
    assert got == {("q", "a"), ("q", "b"), ("p", "a"), ("p", "d")}


def test_assigned_communities(spark):
    e = spark.createDataFrame([("a", 1), ("b", 2)], "id string, community int")
    got = {r.id: r.community for r in community.assign(e, spark.createDataFrame([("a", 5)], "id string, community int")).collect()}
    assert got == {"a": 5, "b": None}


def test_best_rows_keep_the_order_of_equal_ones():
    import numpy as np

    from lattica.functions.vector import best_rows

    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (7, 3), (40, 5)):
        scores = rng.integers(0, 6, (n, 9)).astype(float)
        scores[rng.random(scores.shape) < 0.1] = np.nan
        row, column = best_rows(scores, k)
        for c in range(9):
            want = sorted((i for i in range(n) if scores[i, c] == scores[i, c]), key=lambda i: (-scores[i, c], i))[:k]
            assert sorted(row[column == c].tolist()) == sorted(want)


def test_vectors_beyond_a_broadcast(spark, monkeypatch):
    from lattica.functions import vector

    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)]
    base = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = base.filter("id % 20 = 0").withColumnRenamed("id", "question_id")
    first = {tuple(r) for r in vector.cosine_topk(asked, base, 4).collect()}
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector, "BLOCK", 4)
    assert {tuple(r) for r in vector.cosine_topk(asked, base, 4).collect()} == first and len(first) == 60


def most_rows(df):
    """The rows of ``df``, and the most rows that any step of its plan gave."""
    rows = df.collect()

    def most(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return most(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return most(node.plan())
        found = node.metrics().get("numOutputRows")
        children = node.children()
        return max([found.get().value() if found.isDefined() else 0, *(most(children.apply(i)) for i in range(children.size()))])

    return rows, most(df._jdf.queryExecution().executedPlan())


def test_induced_does_not_list_a_hub_once_a_seed(spark):
    """100 seeds share a hub with 2,000 relationships (either way round) and have three of its neighbours each."""
    rel = [("hub", f"n{i}", "x", 1.0, "d") if i % 2 else (f"n{i}", "hub", "x", 1.0, "d") for i in range(2000)] + [("hub", "hub", "self", 2.0, "d"), ("n1", "n2", "y", 1.0, "d")]
    nodes = [(f"s{s}", n) for s in range(100) for n in ("hub", f"n{s}", f"n{s + 1}", f"n{s + 200}")]
    of = {}
    for s, n in nodes:
        of.setdefault(s, set()).add(n)
    want = {(s, *r) for s, own in of.items() for r in rel if r[0] in own and r[1] in own}
    r = spark.createDataFrame(rel, "source_id string, target_id string, label string, weight double, source_doc string")
    rows, most = most_rows(graph.induced(r, spark.createDataFrame(nodes, "seed string, id string")))
    assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    assert most <= 2 * len(rel)


def test_seeds_are_needed_up_to_one_whose_neighbour_has_many(spark):
    """A seed with one neighbour, which has 40 more: its two hops fill both caps, which the first hop does not tell."""
    edges = [("a", "hub"), ("b", "x"), ("c", "y")] + [("hub", f"n{k}") for k in range(40)] + [("x", f"n{k}") for k in range(30)]
    e = spark.createDataFrame(edges, "src string, dst string")
    entities = spark.createDataFrame([(f"n{k}",) for k in range(20)], "id string")
    seeds = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 3), ("p", "b", 1), ("p", "c", 2)], "question_id string, entity_id string, seed_rank int")
    nodes = graph.k_hop(e, seeds.select(F.col("entity_id").alias("seed")).distinct(), 1)
    got = {(r.question_id, r.entity_id) for r in retrieval.needed_seeds(seeds, nodes, entities, edges=e).collect()}
    assert got == {("q", "b"), ("q", "a"), ("p", "b"), ("p", "c")}


def test_merged_neighborhoods_meet_few_rows_a_seed(spark):
    """50 questions share two seeds of 500 overlapping relationships: only the first of a seed are listed for a question."""
    seeds = spark.createDataFrame([(f"q{k}", s, r) for k in range(50) for r, s in enumerate(("b", "a")[:: 1 if k % 2 else -1], 1)], "question_id string, entity_id string, seed_rank int")
    of = {"a": range(0, 500), "b": range(20, 520)}
    name = lambda i: f"n{i:03}"
    e = spark.createDataFrame([(s, name(i), "N", "T", "D") for s in of for i in of[s]], "seed string, id string, name string, type string, description string")
    r = spark.createDataFrame([(s, name(i), name(i + 1), "l", 1.0, doc) for s in of for i in of[s] for doc in "xy"], "seed string, source_id string, target_id string, label string, weight double, source_doc string")
    entities, relationships = retrieval.merge_neighborhoods(seeds, (e, r))
    rows, most = most_rows(relationships)
    first = {True: range(20, 60), False: range(40)}
    assert {(x.question_id, x["rank"], x.source_id) for x in rows} == {(f"q{k}", n, name(i)) for k in range(50) for n, i in enumerate(first[k % 2 == 1], 1)}
    assert most <= 50 * 2 * 40 * 2
    assert {(x.question_id, x["rank"], x.id) for x in entities.collect()} == {(f"q{k}", n, name(i)) for k in range(50) for n, i in enumerate(list(first[k % 2 == 1])[:20], 1)}
