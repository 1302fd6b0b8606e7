"""Change detection and staged commits of an incremental index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_changes(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(filepath, status) from ``files`` and ``fingerprints`` (filepath, sha256): new, changed, unchanged or stale."""
    now = files.select("filepath", F.col("sha256").alias("now"))
    both = now.join(fingerprints.select("filepath", F.col("sha256").alias("stored")), "filepath", "full_outer")
    status = F.when(F.col("now").isNull(), "stale").when(F.col("stored").isNull(), "new").when(F.col("now") == F.col("stored"), "unchanged").otherwise("changed")
    return both.select("filepath", status.alias("status"))


def latest_fingerprints(log: DataFrame) -> DataFrame:
    """(filepath, sha256, updated_at): the last of each path by time."""
    return log.groupBy("filepath").agg(F.max_by("sha256", "updated_at").alias("sha256"), F.max("updated_at").alias("updated_at"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """``chunks`` (filepath, sha256, chunk_index, ...) with a chunk_id that a rerun makes again."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws(":", "filepath", "chunk_index", "sha256"), 256))


def file_status(files: DataFrame, changes: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """(filepath, outcome): failed if in ``failed``; skipped if unchanged or without chunks; else indexed."""
    has = chunks.select("filepath").distinct().withColumn("has", F.lit(True))
    bad = failed.select("filepath").distinct().withColumn("bad", F.lit(True))
    rows = files.select("filepath").join(changes, "filepath", "left").join(has, "filepath", "left").join(bad, "filepath", "left")
    return rows.select("filepath", F.when(F.col("bad"), "failed").when((F.col("status") == "unchanged") | F.col("has").isNull(), "skipped").otherwise("indexed").alias("outcome"))


def status_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").count()


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


class Store:
    """Tables in a folder that all executors share, committed together.

    A commit writes new versions beside the current ones and then a pointer that names them all; readers follow
    the last pointer, so they see all of a commit or nothing, and a run that stops half-way leaves the old state.
    Old versions stay readable for one more commit.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        """``schemas``: of the tables, also of those that were never written."""
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        at = self._path(f"{self.folder}/pointers")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _named(self, pointer: str) -> dict[str, str]:
        rows = self.spark.read.schema("name string, version string").json(f"{self.folder}/pointers/{pointer}").collect()  # one a table
        return {r["name"]: r["version"] for r in rows}

    def versions(self) -> dict[str, str]:
        found = self._pointers()
        return self._named(found[-1]) if found else {}

    def read(self, name: str) -> DataFrame:
        version = self.versions().get(name)
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/{version}") if version else self.spark.createDataFrame([], self.schemas[name])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Replace each of ``tables``; the others stay as they are."""
        found = self._pointers()
        before = self._named(found[-1]) if found else {}
        now = dict(before)
        for name, df in tables.items():
            now[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.folder}/{name}/{now[name]}")
        number = f"{int(found[-1]) + 1 if found else 0:012d}"
        draft = f"{self.folder}/pointers/_draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(now.items()), "name string, version string").coalesce(1).write.json(draft)
        if self._fs.exists(self._path(f"{self.folder}/pointers/{number}")) or not self._fs.rename(self._path(draft), self._path(f"{self.folder}/pointers/{number}")):
            self._fs.delete(self._path(draft), True)
            raise RuntimeError("another commit came between")
        for old in found[:-1]:
            for name, version in self._named(old).items():
                if version not in (before.get(name), now.get(name)):
                    self._fs.delete(self._path(f"{self.folder}/{name}/{version}"), True)
            self._fs.delete(self._path(f"{self.folder}/pointers/{old}"), True)
