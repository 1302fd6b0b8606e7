"""Quality by ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature of the text is shared by all grades; ordered thresholds cut the score:
P(grade <= k) = sigmoid(threshold_k - score). That gives the expected grade and tail probabilities.
Features are hashed words (each distinct form once), the shares of hashed word shapes, and classes of the
text's length, repetition and kinds of characters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import spared, stage, unstage

#: Labelled rows that the model is fitted on at most: those whose hashed ids are least. The one bound on the input.
SAMPLE_ROWS = 12_000
BITS = 18
#: Words whose features a worker remembers.
CACHE_WORDS = 200_000
#: Rows that a slot must be in to have a weight, and standard errors that its mean grade must be off.
LEAST, SCREEN = 3, 3.0
_RUN = re.compile(r"(.)\1+")
_KEPT = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{str(d): "0" for d in range(10)}})


def _slot(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}\t{text}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def shape(word: str) -> str:
    """The word's kinds of characters, runs as one: a, A, 0, u for other letters, others as they are; eight at most."""
    plain = "".join("u" if c > "\x7f" and c.isalpha() else c for c in word.translate(_KEPT))
    return _RUN.sub(r"\1", plain)[:8]


def classes(text: str, words: list[str], distinct: int) -> list[int]:
    """Slots of the classes of length, repetition and characters of a text."""
    n, lines = len(words), text.split("\n")
    share = lambda part, whole: int(10 * part / whole) if whole else 10
    sample = [
        ("length", n.bit_length()), ("distinct", share(distinct, n) if n < 4096 else f"long{int(20 * np.log(max(2, distinct)) / np.log(n))}"),
        ("word", min(20, len(text) // max(1, n))), ("lines", share(len(set(lines)), len(lines))),
        ("upper", share(sum(map(str.isupper, words)), n)), ("alphabetic", share(sum(map(str.isalpha, words)), n)),
    ]
    return [_slot("class", f"{k} {v}") for k, v in sample]


class Featuriser:
    """Sparse features of texts; the slots of words are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots and values, a slot possibly more than once."""
        words = text.split()
        forms = list(set(words))
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        found = [self.known.get(w) or self._learn(w) for w in forms]
        n = len(found)
        slots = np.array(found, np.int32).reshape(-1, 2)
        whole = classes(text, words, n)
        at, count = np.unique(slots[:, 1], return_counts=True)
        return np.concatenate([slots[:, 0], at, whole]).astype(np.int32), np.concatenate([np.ones(n), 4.0 * count / max(1, n), np.ones(len(whole))]).astype(np.float32)

    def _learn(self, word: str) -> tuple[int, int]:
        self.known[word] = out = (_slot("word", word.lower()[:64]), _slot("shape", shape(word[:64])))
        return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k: one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, rounds: int = 200, decay: float = 3e-4, rate: float = 0.05, least: int = LEAST, screen: float = SCREEN) -> Model:
    """Penalised maximum likelihood by Adam over all ``rows`` (grade, slots, values).

    Slots in fewer than ``least`` rows, or whose rows' mean grade is within ``screen`` standard errors of
    the mean of all, keep weight 0: rare slots are many and would be learnt by heart. Without rows all weights are 0 and the thresholds put
    every text in the highest grade.
    """
    size = 1 << BITS
    weights, cuts = np.zeros(size), np.arange(grades - 1) - (grades - 1.0)
    if not rows:
        return Model(weights, np.full(grades - 1, -20.0) + np.arange(grades - 1))
    grade = np.array([r[0] for r in rows])
    seen, sums = np.zeros(size, np.int64), np.zeros(size)
    for g, slots, _ in rows:  # row by row: all slots at once would take many times the rows' own memory
        once = np.unique(slots)
        seen[once] += 1
        sums[once] += g
    error = grade.std() / np.sqrt(np.maximum(seen, 1))
    used = (seen >= least) & (np.abs(sums / np.maximum(seen, 1) - grade.mean()) > screen * error)
    kept = [used[r[1]] for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [int(k.sum()) for k in kept])
    slots = np.concatenate([r[1][k] for r, k in zip(rows, kept)])
    values = np.concatenate([r[2][k] for r, k in zip(rows, kept)]).astype(float)
    del kept
    names, slots = np.unique(slots, return_inverse=True)
    state = np.zeros(len(names) + grades - 1)
    state[len(names)], state[len(names) + 1 :] = cuts[0], 0.0  # first threshold, then logarithms of the gaps
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        w, first, gaps = state[: len(names)], state[len(names)], np.exp(state[len(names) + 1 :])
        theta = first + np.append(0, np.cumsum(gaps))
        score = np.bincount(owner, values * w[slots], len(rows))
        edge = np.concatenate([np.full((len(rows), 1), -np.inf), theta[None, :] - score[:, None], np.full((len(rows), 1), np.inf)], axis=1)
        cdf = 1 / (1 + np.exp(-np.clip(edge, -40, 40)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        pdf = cdf * (1 - cdf)
        at = np.arange(len(rows))
        p = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-9)
        up, low = pdf[at, grade + 1] / p, pdf[at, grade] / p
        g_theta = np.zeros((len(rows), grades + 1))
        g_theta[at, grade + 1] -= up
        g_theta[at, grade] += low
        g_theta = g_theta[:, 1:-1].mean(axis=0)
        g_w = np.bincount(slots, values * (up - low)[owner], len(names)) / len(rows) + decay * w
        tail = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        state -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[names] = state[: len(names)]
    return Model(weights, state[len(names)] + np.append(0, np.cumsum(np.exp(state[len(names) + 1 :]))))


def train(docs: DataFrame, grades: DataFrame, levels: int, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from ``grades`` (``id_col``, grade 0 to levels - 1; null grades are left out).

    The ``sample_rows`` graded ids with the least hash are used, each once: with its least grade if it has several,
    and of several texts the one whose features sort first. Slots are screened on the executors, by the rule of
    ``fit``, so that the driver gets those that can have a weight: 2^BITS a row at most, and a few for each row
    as a rule.
    """
    chosen = grades.filter("grade is not null").groupBy(id_col).agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select("grade", text_col, F.xxhash64(id_col).alias("h"))
    fields = "grade int, h bigint, slots array<int>, values array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser()
        for batch in batches:
            made = [features(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s for s, _ in made], pa.list_(pa.int32())), pa.array([v for _, v in made], pa.list_(pa.float32()))], names=["grade", "h", "slots", "values"])

    made = texts.mapInArrow(spared(run), fields).groupBy("h").agg(F.min(F.struct("grade", "slots", "values")).alias("r")).select("r.grade", "h", "r.slots", "r.values")
    made = stage(made, "features")
    n, mean, spread = made.agg(F.count("*"), F.avg("grade"), F.stddev_pop("grade")).first()
    if not n:
        return fit([], levels)
    seen = made.select("grade", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"), F.avg("grade").alias("mean"))
    telling = seen.filter((F.col("n") >= LEAST) & (F.abs(F.col("mean") - mean) > SCREEN * (1 - 1e-9) * spread / F.sqrt("n"))).select("slot")
    slots = np.zeros(1 << BITS, bool)
    slots[np.asarray(telling.toArrow()["slot"])] = True
    told = docs.sparkSession.sparkContext.broadcast(slots)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.asarray(s.values, np.int32), np.asarray(v.values, np.float32)) for s, v in zip(batch.column(2), batch.column(3))]
            rows = [(s[told.value[s]].tobytes(), v[told.value[s]].tobytes()) for s, v in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["grade", "h", "slots", "values"])

    rows = made.mapInArrow(spared(screened), "grade int, h bigint, slots binary, values binary").collect()
    unstage(made)
    rows = sorted(rows, key=lambda r: r["h"])
    return fit([(r["grade"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], levels)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with expected_grade and tails (array: P(grade > k) for each k).

    A null text counts as empty. Input columns named like an added one are replaced.
    """
    docs = docs.drop("expected_grade", "tails")
    weights, thresholds = model.weights.astype(np.float32), model.thresholds
    columns = docs.columns
    at = columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, float]] = {}
        for batch in batches:
            scores = []
            for t in batch.column(at):
                text = t.as_py() or ""
                words = text.split()
                forms = set(words)
                if len(known) > CACHE_WORDS:
                    known = {}
                total = other = 0.0
                for w in forms:
                    if (pair := known.get(w)) is None:
                        known[w] = pair = (float(weights[_slot("word", w.lower()[:64])]), float(weights[_slot("shape", shape(w[:64]))]))
                    total += pair[0]
                    other += pair[1]
                whole = classes(text, words, len(forms))
                scores.append(total + 4.0 * other / max(1, len(forms)) + float(weights[whole].sum()))
            tails = Model(weights, thresholds).tails(np.array(scores, float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[*columns, "expected_grade", "tails"])

    return docs.mapInArrow(spared(run), f"{fields}, expected_grade double, tails array<double>")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of three grades from ``labels``: 0 toxic, 1 of low quality, 2 good; null where a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull() | F.col("quality").isNull(), None).otherwise(1 + F.col("quality")).cast("int").alias("grade"))


def grade_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, p_clean (above toxic), p_good (highest grade), and selected: p_good at least ``cut``.

    Every row gives one row; without labels every document is selected.
    """
    model = train(docs, graded(labels), 3, sample_rows)
    out = score_documents(docs.drop("p_clean", "p_good", "selected"), model)
    return out.withColumns({"p_clean": F.col("tails")[0], "p_good": F.col("tails")[1]}).withColumn("selected", F.col("p_good") >= cut).drop("tails")
