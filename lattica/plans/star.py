"""The knowledge graph that the star-schema tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, type, description, community): regions, nations, suppliers, customers and parts; the community
    of suppliers, customers and nations is their region."""
    t = lambda n: read(spark, d, n)
    none = F.lit(None)
    nation = t("nation")
    of = nation.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("community"), "n_name")
    region = t("region").select(_id("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("REGION").alias("type"), none.cast("string").alias("description"), none.cast("int").alias("community"))
    nations = nation.select(_id("nation", "n_nationkey"), "n_name", F.lit("NATION"), none.cast("string"), "n_regionkey")
    supplier = t("supplier").join(F.broadcast(of), F.col("s_nationkey") == F.col("k")).select(_id("supplier", "s_suppkey"), "s_name", F.lit("SUPPLIER"), "n_name", "community")
    customer = t("customer").join(F.broadcast(of), F.col("c_nationkey") == F.col("k")).select(_id("customer", "c_custkey"), "c_name", F.lit("CUSTOMER"), "c_mktsegment", "community")
    part = t("part").select(_id("part", "p_partkey"), "p_name", "p_type", "p_brand", none.cast("int"))
    return region.union(nations).union(supplier).union(customer).union(part)


def observed(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id, label, source_doc), repeats kept: one row for each foreign key and order line."""
    t = lambda n: read(spark, d, n)
    row = lambda df, s, o, label, doc: df.select(s.alias("source_id"), o.alias("target_id"), F.lit(label).alias("label"), F.lit(doc).alias("source_doc"))
    return (
        row(t("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "in_region", "nation")
        .union(row(t("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "in_nation", "supplier"))
        .union(row(t("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "in_nation", "customer"))
        .union(row(t("lineitem"), _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "supplies", "lineitem"))
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, entity_id): each vector's supplier and part by its number."""
    suppliers, parts = read(spark, d, "supplier").count(), read(spark, d, "part").count()
    v = read(spark, d, "embeddings").select("vec_id")
    ids = F.array(F.concat(F.lit("supplier_"), (F.col("vec_id") % suppliers).cast("string")), F.concat(F.lit("part_"), (F.col("vec_id") % parts).cast("string")))
    return v.select(F.col("vec_id").alias("chunk_id"), F.explode(ids).alias("entity_id"))


#: The same tables in SQL, to put before a query.
SQL = """
WITH RECURSIVE e AS (
  SELECT 'region_' || r_regionkey AS id, r_name AS name, 'REGION' AS type, NULL AS description, CAST(NULL AS INTEGER) AS community FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'NATION', NULL, n_regionkey FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'SUPPLIER', n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'CUSTOMER', c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'part_' || p_partkey, p_name, p_type, p_brand, NULL FROM part),
o AS (
  SELECT 'nation_' || n_nationkey AS source_id, 'region_' || n_regionkey AS target_id, 'in_region' AS label, 'nation' AS source_doc FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'in_nation', 'supplier' FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'in_nation', 'customer' FROM customer
  UNION ALL SELECT 'supplier_' || l_suppkey, 'part_' || l_partkey, 'supplies', 'lineitem' FROM lineitem),
r AS (SELECT source_id, target_id, label, source_doc, CAST(count(*) AS DOUBLE) AS weight FROM o GROUP BY ALL),
k AS (
  SELECT vec_id AS chunk_id, 'supplier_' || vec_id % (SELECT count(*) FROM supplier) AS entity_id FROM embeddings
  UNION ALL SELECT vec_id, 'part_' || vec_id % (SELECT count(*) FROM part) FROM embeddings)
"""
