"""The pipeline's stages on planted cases, and the contract queries against their SQL."""

import random

import pytest

import corpus_pipeline
from lattica.llm import queries

SMALL = "/root/testdata/sf0.001"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_stages_in_turn(spark, tmp_path):
    rng = random.Random(3)
    passage = sentence(rng, 60)
    clean = [sentence(rng, 150) for _ in range(300)]
    texts = {i: t for i, t in enumerate(clean)}
    bad = {1000 + i: sentence(rng, 150) + " vile nasty" for i in range(120)}
    texts |= bad | {2000: clean[0], 2001: clean[1] + " more", 2002: passage + " " + sentence(rng, 50), 2003: sentence(rng, 50) + " " + passage}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(250)] + [(i, 1, 1) for i in range(1000, 1100)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    kept, now = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert now.columns == docs.columns
        kept[name] = {r.doc_id for r in now.collect()}
    assert len(kept["quality"] & set(bad)) <= 6 and len(kept["quality"] - set(bad)) >= 0.98 * (len(texts) - len(bad))
    assert kept["quality"] - kept["exact"] == {0} and kept["exact"] - kept["near"] <= {1, 2001} and len(kept["exact"] - kept["near"]) == 1
    cut = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "repeats")).filter("doc_id >= 2002").collect()}
    assert all(passage not in r.text and r.n_chars == len(r.text) for r in cut.values())
    assert kept["near"] == kept["repeats"] == kept["pack"]


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and blank texts, repeated rows, clashing names, no rows: no stage fails, and rows stay as stated."""
    names = "doc_id long, text string, lang string, source string, n_chars long, group_id string, kept string, p_good string, d1 string, node string, row string, text_sha256 string"
    rows = [(1, "a b c", "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0), (3, "   ", None, "s", 3), (1, "a b c", "en", "s", 3), (4, "long é " * 30_000, "de", "s", None), (4, None, "de", "s", None)]
    docs = spark.createDataFrame([(*r, *["z"] * 7) for r in rows], names)
    want = {"quality": 7, "exact": 4, "near": 4, "repeats": 4}  # texts: a b c, none (null and empty), blank, long; texts without words are near themselves alone
    for table in (docs, docs.filter("false")):
        now = table
        for name, function in corpus_pipeline.STAGES:
            made = function(spark, now, SMALL)
            now = spark.createDataFrame(made.collect(), made.schema)
            if name != "pack":
                assert now.columns == docs.columns
                if name == "quality":  # whatever the classifier says, the next stages get all rows
                    assert now.count() <= table.count()
                    now = table
                else:
                    assert now.count() == (want[name] if table is docs else 0)
            else:
                assert now.filter("start = 0").count() == (4 if table is docs else 0)


def test_repeats_cuts_passages_of_short_words(spark):
    rng = random.Random(4)
    short = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 4))) for _ in range(n))
    passage, less = short(51), short(50)
    assert len(passage) < 256
    texts = [f"{sentence(rng, 40)} {p} {sentence(rng, 40)}" for p in (passage, passage, less, less)] + [passage]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, docs, SMALL).collect()}
    assert all(passage not in got[i] and got[i] == texts[i].replace(passage, "") for i in (0, 1, 4))
    assert got[2] == texts[2] and got[3] == texts[3]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), oracle.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    x, y = (f[cols].astype(object).where(f[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for f in (got, want))  # nulls of all kinds alike
    assert x.equals(y)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/{'conversations' if name.startswith('op1_') else 'documents'}.parquet").count()
    assert got.count() >= n


def test_near_takes_links_of_fingerprints(spark):
    """Texts of one phrase many times and a few words of their own: their sets of shingles differ, their fingerprints hardly; texts without words are not linked."""
    from lattica.llm.near_dedup import near_dedup
    from lattica.llm.simhash import near_duplicates

    rng = random.Random(6)
    texts = ["red fox runs " * 200 + sentence(rng, 10) for _ in range(3)] + [sentence(rng, 120) for _ in range(30)] + ["", " \t ", None]
    texts += [texts[5] + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    alike = {r.doc_id for r in near_duplicates(docs).collect() if r.component_id == 0}
    assert alike == {0, 1, 2}
    alone = {r.doc_id for r in near_dedup(docs).filter("kept").collect()}
    assert alike <= alone
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, SMALL).collect()}
    assert kept == alone - {1, 2} and len(texts) - 1 not in kept
