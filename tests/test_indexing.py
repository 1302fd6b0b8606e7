"""Models, prompts and index runs."""

import random
import sys
from dataclasses import replace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lattica import models
from lattica.config import DEFAULT, EngineConfig
from lattica.functions import network
from lattica.operators import community, extraction, generation, indexing
from lattica.operators.chunking import Splitter
from lattica.sources import files
from lattica.streaming import limiter

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file

def test_retries():
    asked, waited = [], []

    def call(errors):
        asked.append(1)
        if errors:
            raise errors.pop(0)
        return "ok"

    again = lambda errors, **k: generation.retried(lambda: call(errors), wait=waited.append, **k)
    assert again([generation.ModelError("busy", 503), ConnectionError()]) == "ok" and len(asked) == 3 and len(waited) == 2
    with pytest.raises(generation.ModelError):
        again([generation.ModelError("bad", 400)])
    assert len(asked) == 4
    with pytest.raises(OSError):
        again([OSError()] * 5)
    assert len(asked) == 7
    with pytest.raises(generation.Cancelled):
        again([], cancelled=lambda: True)


def test_answers_and_streams():
    assert generation.answer_of({"response": "x"}) == "x" and generation.request("m", "p", "json") == {"model": "m", "prompt": "p", "stream": False, "format": "json"}
    for bad in ({}, [], None):
        with pytest.raises(generation.ModelError):
            generation.answer_of(bad)
    lines = ['{"response": "a"}', "junk", "[1]", b'{"response": "b"}', '{"response": "", "done": true}', '{"response": "c"}']
    assert list(generation.streamed(lines)) == ["a", "b"]
    with pytest.raises(generation.ModelError):
        list(generation.streamed(['{"error": "no"}']))
    model = models.ServedModel("m", lambda body: {"response": body["prompt"].upper()}, lambda body: iter(lines))
    assert model.generate("hi") == "HI" and list(generation.ask_stream("q", model)) == ["a", "b"]
    assert list(generation.ask_stream("q", model, cancelled=lambda: True)) == []


class Failing:
    """Fails on prompts with a word, offline else."""

    def __init__(self, word):
        self.word = word

    def generate(self, prompt, form=None):
        if self.word in prompt:
            raise generation.ModelError("no")
        return models.OfflineModel().generate(prompt, form)


def test_one_failed_call_leaves_the_others(spark):
    rows = spark.createDataFrame([("f", "s", 0, "Alpha meets Beta"), ("f", "s", 1, "boom Gamma"), ("f", "s", 2, "never asked")], "filepath string, sha256 string, batch_index int, text string")
    cache = spark.createDataFrame([("f", "s", 2, "{}"), ("f", "old", 0, "x")], indexing.SCHEMAS["cache"])
    told = extraction.extract(rows, cache, Failing("boom"))
    assert {(r.batch_index, r.result is None, r.fresh) for r in told.collect()} == {(0, False, True), (1, True, True), (2, False, False)}
    parsed = extraction.parse_answers(told)
    assert [r.batch_index for r in parsed.filter("had_failure").collect()] == [1]
    assert {r.name for r in extraction.normal_entities(parsed).collect()} == {"Alpha", "Beta"}
    assert [tuple(r) for r in extraction.cached_answers(cache.filter("sha256 = 's'")).collect()] == [("f", {2: "{}"})]
    assert extraction.cache_clear(cache, rows.select("filepath").distinct()).count() == 0


def test_links_are_inserted_once(spark):
    links = spark.createDataFrame([("1", "a")], "chunk_id string, entity_id string")
    new = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b")], "chunk_id string, entity_id string")
    assert sorted(tuple(r) for r in extraction.link_append(links, new).collect()) == [("1", "a"), ("1", "b")]


def test_index_runs(spark, tmp_path):
    store = indexing.open_store(spark, str(tmp_path))
    config = replace(DEFAULT, chunk_size=40, chunk_overlap=10, max_chunk_chars=40, batch_tokens=10)
    embedder = models.HashingEmbedder(16)

    def run(contents, model=models.OfflineModel()):
        rows = spark.createDataFrame(list(contents.items()), "filepath string, text string").withColumn("sha256", F.sha2("text", 256))
        return {r.filepath: r.outcome for r in indexing.index(store, rows, embedder, model, config).collect()}

    one = {"a.md": "Alpha calls Beta here.\n\nBeta likes Gamma a lot.", "b.md": "Gamma and Delta boom.\n\nEpsilon is with Alpha and others.", "c.md": "  \n"}
    assert run(one, Failing("boom")) == {"a.md": "indexed", "b.md": "failed", "c.md": "skipped"}
    assert {r.filepath for r in store.read("fingerprints").collect()} == {"a.md"} and store.read("chunks").filter("size(vector) = 16").count() >= 2
    assert {"alpha", "beta", "gamma"} <= {r.id for r in store.read("entities").collect()}
    asked = store.read("cache").filter("filepath = 'b.md'").count()
    assert asked >= 1  # the batch that did not fail
    weight = lambda: {(r.source_id, r.target_id): r.weight for r in store.read("relationships").collect()}
    assert weight()["alpha", "beta"] == 1.0
    assert run(one) == {"a.md": "skipped", "b.md": "indexed", "c.md": "skipped"}
    assert {r.filepath for r in store.read("fingerprints").collect()} == {"a.md", "b.md"} and weight()["alpha", "beta"] == 1.0
    before = store.read("entities").count()
    assert run(one) == {"a.md": "skipped", "b.md": "skipped", "c.md": "skipped"} and store.read("entities").count() == before
    two = {"a.md": "Zeta alone in here.", "c.md": ""}  # changed, and b.md is gone
    assert run(two) == {"a.md": "indexed", "c.md": "skipped"}
    assert {r.id for r in store.read("entities").collect()} == {"zeta"} and weight() == {} and {r.filepath for r in store.read("chunks").collect()} == {"a.md"}
    assert [r.chunk_index for r in indexing.chunks_of(store.read("chunks"), "a.md").collect()] == [0]
    assert {r.filepath for r in store.read("cache").collect()} == {"a.md"}
    with pytest.raises(RuntimeError, match="vector size"):
        indexing.index(store, spark.createDataFrame([("x", "y", "z")], "filepath string, sha256 string, text string"), models.HashingEmbedder(8), models.OfflineModel(), config)


def test_embeddings(spark):
    class Short(models.HashingEmbedder):
        def embed_batch(self, texts):
            return super().embed_batch(texts)[1:]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", " \u00a0 ", None, "one two", "two"])], "i int, text string")
    got = {r.i: r.vector for r in models.with_embeddings(rows, "text", models.HashingEmbedder(8), batch=2).collect()}
    assert got[1] is None and got[2] is None and got[0] == got[3] != got[4] and abs(sum(x * x for x in got[0]) - 1) < 1e-5
    assert models.embed_one(models.HashingEmbedder(8), "two") == pytest.approx(got[4])
    with pytest.raises(Exception, match="embeddings"):
        models.with_embeddings(rows, "text", Short(8)).collect()
    with pytest.raises(generation.ModelError, match="not 8"):
        models.right_vectors([[0.0] * 7], 1, 8)
    with pytest.raises(Exception, match="vector size"):
        rows.select(models.checked(F.array(F.lit(1.0)), 2)).collect()


def test_summaries_by_a_model(spark):
    e = spark.createDataFrame([("a", "Aa", "T", "d", 0), ("b", "Bb", "", None, 0), ("z", "boom", None, None, 1)], "id string, name string, type string, description string, community int")
    r = spark.createDataFrame([("a", "b", "calls", "f", 1.0)], "source_id string, target_id string, label string, source_doc string, weight double")
    prompts = {x.id: x.prompt for x in community.summary_prompts(e, r, community.active_communities(e)).collect()}
    assert prompts[0] == community.SUMMARY_PROMPT + "- Aa (T): d\n- Bb (unknown): \n\nConnections:\n- a --[calls]--> b" and "Connections" not in prompts[1]
    none = spark.createDataFrame([], indexing.SCHEMAS["communities"])
    run = lambda known, model, **k: {x.id: x for x in community.summarise_all(e, r, known, model, models.HashingEmbedder(4), **k).collect()}
    first = run(none, Failing("boom"))
    assert {i: x.status for i, x in first.items()} == {0: "summarised", 1: "failed"} and first[1].member_hash is None and len(first[0].vector) == 4
    known = spark.createDataFrame([(x.id, x.member_hash, x.summary, x.vector) for x in first.values()], indexing.SCHEMAS["communities"])
    assert {i: x.status for i, x in run(known, models.OfflineModel()).items()} == {0: "kept", 1: "summarised"}
    assert {x.status for x in run(known, models.OfflineModel(), force=True).values()} == {"summarised"}
    assert community.with_members(spark.createDataFrame([(1, '["a", "b"]')], "id int, entity_ids string")).first().entity_ids == ["a", "b"]


def test_answers_to_questions(spark):
    prompts = spark.createDataFrame([("q", "Passages:\n x\n\nwhat? "), ("p", "boom")], "question_id string, prompt string")
    got = {r.question_id: r for r in generation.ask(prompts, Failing("boom"), slots=2).collect()}
    assert got["q"].answer == "what?" and got["p"].answer is None and "ModelError" in got["p"].error


def test_safe_files(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir(), outside.mkdir()
    (inside / "a.md").write_text("x")
    (outside / "b.md").write_text("x")
    (outside / "deep").mkdir()
    (outside / "deep" / "c.md").write_text("x")
    (inside / "link.md").symlink_to(outside / "b.md")
    (inside / "own.md").symlink_to(inside / "a.md")
    (inside / "folder").symlink_to(outside / "deep")
    found = files.scan(spark, files.fallback_settings(str(inside)))
    assert [r.filepath.rsplit("/", 1)[1] for r in found.collect()] == ["a.md"]
    rows = [("/r/a.md", 5, False, True), ("/r/a.md", 5, True, True), ("/r/a.exe", 5, False, True), ("/r/a.md", 5, False, False), ("/s/a.md", 5, False, True), ("/r/a.md", 50, False, True)]
    assert files.safe(spark.createDataFrame(rows, "path string, length long, is_link boolean, is_file boolean"), ["/r"], max_bytes=10).count() == 1
    assert files.normal("s3a://b/x/") == "s3a://b/x" and files.normal(str(inside / "own.md")) == str((inside / "a.md").resolve())


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "index.yaml"
    path.write_text("index_paths:\n  - path: /x\n    exclude_dirs: venv\nignore_patterns: ['*.log']\n")
    got = files.load_settings(str(path))
    assert got.paths[0].exclude_dirs == {"venv"} and got.ignore_patterns == ("*.log",)
    path.write_text("a: [")
    with pytest.raises(ValueError):
        files.load_settings(str(path))


def test_network(spark):
    rows = [("10.0.0.1", " 1.2.3.4 , 5.6.7.8"), ("10.0.0.1", "junk"), ("9.9.9.9", "1.2.3.4"), ("10.0.0.1", None), ("10.0.0.1", "::1")]
    df = spark.createDataFrame(rows, "peer string, header string")
    assert [r[0] for r in df.select(network.client_address(F.col("peer"), F.col("header"), ["10.0.0.1"])).collect()] == ["1.2.3.4", "10.0.0.1", "9.9.9.9", "10.0.0.1", "::1"]
    df = spark.createDataFrame([("Bearer abc ", "a=1; sid=x=y"), ("Basic abc", "b=2"), (None, None)], "a string, c string")
    assert [tuple(r) for r in df.select(network.bearer_token(F.col("a")), network.cookie(F.col("c"), "sid")).collect()] == [("abc", "x=y"), (None, None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("x" * 72,), ("é" * 37,)], "p string").select(network.password_fits(F.col("p"))).collect()] == [True, False]


def test_login_limit(spark):
    rows = [("k", i * 1_000_000, i) for i in range(12)] + [("k", 60_000_000, 99)]
    got = limiter.login_limit(spark.createDataFrame(rows, "key string, at long, id long")).orderBy("id").collect()
    assert [r.accepted for r in got] == [True] * 10 + [False] * 2 + [True]
    users = spark.createDataFrame([("b", "h", 1.0), ("a", "h", 2.0)], "username string, password_hash string, created_at double")
    assert [r.username for r in limiter.list_users(users).collect()] == ["a", "b"]


def plain_windows(parts, sep, size, overlap):
    """Windows by the contract, one part after another."""
    out, held = [], []
    width = lambda ps: len(sep.join(ps))
    for p in parts:
        if held and width(held + [p]) > size:
            out.append(sep.join(held))
            while held and width(held) > overlap:
                held = held[1:]
        held = held + [p]
    return out + ([sep.join(held)] if held else [])


def test_windows_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        size = rng.randrange(5, 40)
        overlap = rng.randrange(0, size)
        s = Splitter(EngineConfig(chunk_size=size, chunk_overlap=overlap, max_chunk_chars=40))
        sep = rng.choice([" ", "\n\n", ""])
        parts = ["x" * rng.randrange(1, size + 1) for _ in range(rng.randrange(0, 25))]
        assert list(s._pack(parts, sep)) == plain_windows(parts, sep, size, overlap)


def test_splitting_loses_nothing():
    """Every word is in some chunk, in order, and chunks keep to the bound."""
    rng = random.Random(9)
    for _ in range(60):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 120))]
        text = "".join(w + rng.choice([" ", "\n", "\n\n", " \n"]) for w in words)
        chunks = Splitter(EngineConfig(chunk_size=50, chunk_overlap=10, max_chunk_chars=60)).text(text)
        assert all(0 < len(c) <= 62 for c in chunks)
        at = 0
        for w in words:
            while w not in chunks[at].split():
                at += 1
                assert at < len(chunks)


def test_python_chunks_hold_all_statements():
    s = Splitter()
    rng = random.Random(10)
    for _ in range(40):
        kinds = [rng.choice(["import m{0}", "def f{0}():\n    return {0}", "class K{0}:\n    x = {0}", "V{0} = {0}", "# note {0}", "a{0} = 1; b{0} = 2"]).format(k) for k in range(rng.randrange(1, 12))]
        found = s.document("x.py", "\n".join(kinds) + "\n")
        text = "\n".join(c for c, _ in found)
        code = [k for k in kinds if not k.startswith("import")]
        if any(not k.startswith(("import", "#")) for k in kinds):
            assert all(line in text for k in code for line in k.split("; ")) and "import" not in text
            assert [n for _, n in found if n] == [k.split("(")[0].split(":")[0].split()[1] for k in code if k.startswith(("def", "class"))]


def test_markdown_sections_hold_all_lines():
    s = Splitter(EngineConfig(chunk_size=50, chunk_overlap=10, max_chunk_chars=80))
    rng = random.Random(11)
    for _ in range(60):
        lines = [rng.choice(["# Head {0}", "text of line {0}", "", "###### low {0}", "#tag {0}"]).format(k) for k in range(rng.randrange(1, 30))]
        found = [c for c, _ in s.document("x.md", "\n".join(lines))]
        seen = "\n".join(found)
        assert all(line in seen for line in lines) and all(len(c) <= 80 for c in found)
        heads = [x for x in lines if x.startswith(("# ", "###### "))]
        assert all(sum(c.split("\n").count(h) for c in found) == 1 for h in heads)
        assert all(line not in heads for c in found for line in c.split("\n")[1:])
