"""What the operators of this subpackage share: staged tables, tables of a run, task sizes and memory."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a default if there is one machine only."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (told or DEFAULT_SHARED_DIR).rstrip("/")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (in folders by the column ``by``) and read it back.

    Later jobs then read one fixed copy that survives the loss of any executor, and task-dependent
    values such as partition numbers are computed once. ``unstage`` removes it when nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_by(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """``stage``, in buckets by ``keys``: joins and groups by these do not shuffle it again.

    The table is known to the session only while it is opened; its files stay in the shared folder.
    """
    spark = df.sparkSession
    table, n = f"lattica_{name}_{uuid.uuid4().hex}", partitions(spark)
    path = f"{shared_dir(spark)}/lattica/{table}"
    df.repartition(n, *keys).write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(n, *keys).saveAsTable(table)
    out = spark.table(table)
    out.staged_at = path
    out.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def unstage(*tables: DataFrame) -> None:
    """Remove staged ``tables``; only what no later plan reads, lazily or on a retry, may be given."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """This worker's allocators give back what they hold free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def spared(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` without batches of no rows, after which the worker's allocators give back what they hold free.

    Workers serve one task after another, of all stages: what one leaves in them counts against the next.
    """

    def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b for b in batches if b.num_rows)
        finally:
            give_back()

    return spare


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as one compressed value: byte by byte of the numbers' places, so that leading zeros are runs."""
    parts = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        parts += [np.array([len(a), a.dtype.itemsize], "<u4").tobytes(), a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 4
    for _ in range(int(plain[:4].view("<u4")[0])):
        n, size = plain[at : at + 8].view("<u4").tolist()
        out.append(np.ascontiguousarray(plain[at + 8 : at + 8 + n * size].reshape(size, n).T).view(f"<u{size}").ravel())
        at += 8 + n * size
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(df[text_col], F.lit(""))


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Internal column names that ``df`` (compared without case) does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = f"__{w}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
