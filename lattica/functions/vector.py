"""Vector search: exact cosine top-k for a table of questions, block by block, and dimension checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions of a block and base rows of a chunk (both a few, so that a matrix of their scores is 32 MB), and bytes of blocks that may be broadcast.
BLOCK, CHUNK, BROADCAST_BYTES = 2048, 2048, 64 << 20
DIGITS = 6


def right_size(vector: Column, size: int) -> Column:
    """False for missing vectors and those of another size."""
    return F.coalesce(F.size(vector) == size, F.lit(False))


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    m = np.asarray(flat, np.float64).reshape(-1, size)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each column of ``scores``, of equal ones those of the first rows; no NaN."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    n = len(scores)
    if n > k:
        bar = np.partition(scores, n - k, axis=0)[n - k]
        above, level = scores > bar, scores == bar
        keep = above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & (scores > -np.inf))


def cosine_topk(questions: DataFrame, base: DataFrame, k: int, descending_ids: bool = False) -> DataFrame:
    """(question_id, id, score, rank): for each question the ``k`` rows of ``base`` (id, vector) nearest by cosine.

    ``questions``: (question_id, vector). Scores are rounded to six digits; ties go to the lesser id (the
    greater with ``descending_ids``). Null vectors, those of another size, and NaN scores are left out; a zero
    vector has score 0.

    Questions are a table of blocks, base rows one of chunks; each chunk meets each block of its size in a
    worker, which returns k rows a question. Blocks are broadcast if they are small, else dealt to all tasks
    with copies of the chunks' rows: nothing is gathered on the driver.
    """
    spark = base.sparkSession
    kind, qkind = (df.schema[c].dataType.simpleString() for df, c in ((base, "id"), (questions, "question_id")))
    asked = questions.select("question_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and size(vector) > 0")
    n, numbers = asked.agg(F.count("*"), F.sum(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], f"question_id {qkind}, id {kind}, score double, rank int")
    block = F.pmod(F.xxhash64("question_id"), F.lit(-(-n // BLOCK)))
    blocks = asked.groupBy(block.alias("block"), F.size("vector").alias("d")).agg(F.collect_list("question_id").alias("questions"), F.flatten(F.collect_list("vector")).alias("asked"))

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.asarray(whole.column(1).value_lengths())
            for d in np.unique(sizes).tolist():
                own = whole.filter(pa.array(sizes == d))
                for a in range(0, own.num_rows, CHUNK):
                    part = own.slice(a, CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)), pa.ListArray.from_arrays(pa.array([0, d * part.num_rows], pa.int32()), part.column(1).flatten())], names=["d", "ids", "numbers"])

    usable = base.select("id", F.col("vector").cast("array<double>").alias("vector")).filter("vector is not null and size(vector) > 0")
    chunks = usable.mapInArrow(chunked, f"d int, ids array<{kind}>, numbers array<double>")
    if 8 * numbers <= BROADCAST_BYTES:
        pairs = chunks.join(F.broadcast(blocks.drop("block")), "d")
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        everywhere = blocks.drop("block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        pairs = chunks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).join(everywhere, ["d", "salt"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, ids, numbers, questions, asked = (batch.column(c)[i] for c in range(5))
                names = ids.values
                order = pa.compute.array_sort_indices(names, order="descending" if descending_ids else "ascending").to_numpy()
                unit = _unit(numbers.values.to_numpy(), d.as_py())[order]
                scores = np.round(unit @ _unit(asked.values.to_numpy(), d.as_py()).T, DIGITS) + 0.0
                row, column = best_rows(scores, k)
                yield pa.RecordBatch.from_arrays([questions.values.take(pa.array(column)), names.take(pa.array(order[row])), pa.array(scores[row, column])], names=["question_id", "id", "score"])

    found = pairs.select("d", "ids", "numbers", "questions", "asked").mapInArrow(score, f"question_id {qkind}, id {kind}, score double")
    tie = F.desc("id") if descending_ids else F.asc("id")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), tie))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
