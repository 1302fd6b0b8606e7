"""Every registered query of the engine against its SQL, over the smallest tables."""

import pytest

from lattica.plans import catalog

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x, y = (f[cols].astype(object).where(f[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True) for f in (a, b))  # nulls of all kinds alike
    assert x.equals(y)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    if name in catalog.ORACLE_SQL:
        same(got, oracle.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["question_id", "kind", "rank", "item"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_louvain_beats_components(spark):
    from lattica.operators import community, graph

    edges = graph.undirected(graph.simple_graph(catalog._relationships(spark, SMALL).filter("source_doc <> 'lineitem'")))
    found = community.louvain(edges).cache()
    nodes = edges.select("src").union(edges.select("dst")).distinct().count()
    assert found.count() == nodes == found.select("id").distinct().count()
    whole = graph.components(edges).withColumnRenamed("component", "community")
    assert community.modularity(edges, found) >= community.modularity(edges, whole) > -1
    assert found.join(whole.withColumnRenamed("community", "c"), "id").groupBy("community").agg({"c": "count"}).count() == found.select("community").distinct().count()


def test_coarsened_louvain_is_about_as_good(spark):
    """With room for a few edges only, the graph is made coarser first: nodes stay, and modularity nearly does."""
    from lattica.operators import community, graph

    edges = graph.undirected(graph.simple_graph(catalog._relationships(spark, SMALL).filter("source_doc <> 'lineitem'")))
    cliques = [(f"{g}{a}", f"{g}{b}", 1.0) for g in range(12) for a in range(6) for b in range(a + 1, 6)] + [(f"{g}0", f"{(g + 1) % 12}1", 1.0) for g in range(12)]
    for e in (edges, spark.createDataFrame(cliques, "src string, dst string, weight double")):
        whole, coarse = community.louvain(e).cache(), community.louvain(e, local_edges=60).cache()
        assert coarse.count() == whole.count() == coarse.select("id").distinct().count()
        assert community.modularity(e, coarse) > 0.9 * community.modularity(e, whole)
        numbers = sorted(r.community for r in coarse.select("community").distinct().collect())
        assert numbers == list(range(len(numbers)))


def test_coarsened_louvain_reads_its_edges_once(spark, monkeypatch):
    """A plan of edges that is dear runs once; packed parts and joins by node agree with the whole graph's solution in quality."""
    from pyspark.sql import functions as F

    from lattica.operators import community

    cliques = [(f"{g}-{a}", f"{g}-{b}", 1.0) for g in range(30) for a in range(6) for b in range(a, 6)] + [(f"{g}-0", f"{(g + 1) % 30}-1", 1.0) for g in range(30)]
    plain = spark.createDataFrame(cliques, "src string, dst string, weight double").cache()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    whole = community.modularity(plain, community.louvain(plain))
    monkeypatch.setattr(community, "PART_ENDS", 100)
    for told in (1_000_000, 0):
        monkeypatch.setattr(community, "TOLD_NODES", told)
        before = seen.value
        found = community.louvain(plain.mapInArrow(count, plain.schema), local_edges=100).cache()
        assert found.count() == 180 == found.select("id").distinct().count()
        assert seen.value - before == len(cliques)
        assert community.modularity(plain, found) > 0.9 * whole
        first = found.groupBy("community").agg(F.min("id").alias("least")).orderBy("community").collect()
        assert [r.community for r in first] == list(range(len(first))) and [r.least for r in first] == sorted(r.least for r in first)
