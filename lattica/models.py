"""Pluggable models with deterministic offline defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.config import DEFAULT
from lattica.functions.text import prepared_for_embedding
from lattica.operators import generation


class Embedder(Protocol):
    dimension: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class TextModel(Protocol):
    """Answers prompts; ``form`` 'json' asks for a JSON object."""

    def generate(self, prompt: str, form: str | None = None) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class HashingEmbedder:
    """Counts of hashed words with hashed signs, of unit length."""

    def __init__(self, dimension: int = DEFAULT.vector_size):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            marks = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in re.findall(r"\w+", text.lower())]
            np.add.at(row, [m % self.dimension for m in marks], [1.0 - 2.0 * (m >> 31) for m in marks])
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1.0)).tolist()


class ServedModel:
    """A text model behind ``post`` (body -> parsed answer) and ``lines`` (body -> lines of a stream)."""

    def __init__(self, name: str, post: Callable[[dict], dict], lines: Callable[[dict], Iterator[bytes]] | None = None, retries: int = generation.RETRIES, pause: float = generation.PAUSE):
        self.name, self.post, self.lines, self.retries, self.pause = name, post, lines, retries, pause

    def generate(self, prompt: str, form: str | None = None) -> str:
        return generation.answer_of(generation.retried(lambda: self.post(generation.request(self.name, prompt, form)), self.retries, self.pause))

    def stream(self, prompt: str) -> Iterator[str]:
        yield from generation.streamed(generation.retried(lambda: self.lines(generation.request(self.name, prompt, stream=True)), self.retries, self.pause))


def model_names(fetch: Callable[[], dict], default: str) -> list[str]:
    """The served models' names from what ``fetch`` gives ({"models": [{"name": ...}]}); the default alone on any failure."""
    try:
        return [str(m["name"]) for m in fetch()["models"]] or [default]
    except Exception:
        return [default]


class OfflineModel:
    """Answers without a server: in JSON, the names that a text has (capitalised words and identifiers) and which
    stand in one line; else the prompt's last paragraph."""

    _NAME = re.compile(r"\b(?:[A-Z][a-z]\w+|[a-z]+(?:_\w+)+)\b")

    def generate(self, prompt: str, form: str | None = None) -> str:
        text = prompt.rsplit("\nText:\n", 1)[-1]
        if form != "json":
            return text.strip().rsplit("\n\n", 1)[-1]
        names, pairs = {}, []
        for line in text.split("\n"):
            found = list(dict.fromkeys(self._NAME.findall(line)))
            for n in found:
                names.setdefault(n, line.strip()[:200])
            pairs += [(a, b) for a, b in zip(found, found[1:])]
        entities = [{"name": n, "type": "FUNCTION" if "_" in n else "CONCEPT", "description": d} for n, d in names.items()]
        return json.dumps({"entities": entities, "relationships": [{"source": a, "target": b, "label": "mentioned with"} for a, b in pairs]})

    def stream(self, prompt: str) -> Iterator[str]:
        for word in self.generate(prompt).split(" "):
            yield word + " "


def right_vectors(vectors, texts: int, dimension: int) -> list:
    """A batch's vectors, one for each text and of the right size, or an error."""
    if len(vectors) != texts:
        raise generation.ModelError(f"{texts} texts, but {len(vectors)} embeddings")
    for v in vectors:
        if len(v) != dimension:
            raise generation.ModelError(f"an embedding has {len(v)} numbers, not {dimension}")
    return vectors


def embed_one(embedder: Embedder, text: str) -> list[float]:
    return right_vectors(embedder.embed_batch([text]), 1, embedder.dimension)[0]


def checked(vector: Column, dimension: int) -> Column:
    """``vector``, or an error for the whole query where its size is another."""
    size = F.size(vector)
    return F.when(vector.isNull() | (size == dimension), vector).otherwise(F.raise_error(F.concat(F.lit(f"vector size is not {dimension} but "), size.cast("string"))))


def with_embeddings(df: DataFrame, text_col: str, embedder: Embedder, out: str = "vector", limit: int = DEFAULT.max_embed_chars, batch: int = 256) -> DataFrame:
    """``df`` with the embedding of each stripped and cut text, null where nothing is left; the embedder gets
    ``batch`` texts at a time, and none at all if all are empty."""
    df = df.drop(out)
    rows = df.withColumn("_ready", prepared_for_embedding(F.col(text_col), limit))
    names, at = [*df.columns, out], len(df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                texts = part.column(at).to_pylist()
                asked = [t for t in texts if t is not None]
                found = iter(right_vectors(embedder.embed_batch(asked), len(asked), embedder.dimension) if asked else [])
                vectors = [None if t is None else next(found) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(vectors, pa.list_(pa.float32()))], names=names)

    return rows.mapInArrow(run, schema)
