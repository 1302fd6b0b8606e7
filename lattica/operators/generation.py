"""Text models: calls with bounded retries, streams of answers, and columns of answers with failures kept apart."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.functions.text import stripped

#: Calls after the first that a failing server gets, and seconds between them.
RETRIES, PAUSE = 2, 1.0


class ModelError(RuntimeError):
    """An answer that can't be used, or a call that was refused; ``status`` as in HTTP, or None."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Cancelled(RuntimeError):
    pass


def retried(call: Callable[[], object], retries: int = RETRIES, pause: float = PAUSE, cancelled: Callable[[], bool] = lambda: False, wait: Callable[[float], None] = time.sleep):
    """What ``call`` returns. Errors of the server (status 500 and up) and of the transport are tried again, up to
    ``retries`` times; others are raised at once. ``cancelled`` is asked before each call."""
    for left in range(retries, -1, -1):
        if cancelled():
            raise Cancelled("cancelled before a call")
        try:
            return call()
        except (ModelError, OSError) as e:
            passing = not isinstance(e, ModelError) or (e.status or 0) >= 500
            if not passing or not left:
                raise
            wait(pause)


def request(model: str, prompt: str, form: str | None = None, stream: bool = False) -> dict:
    """The body of a request to generate."""
    return {"model": model, "prompt": prompt, "stream": stream} | ({"format": form} if form else {})


def answer_of(body) -> str:
    """The text of a whole answer."""
    if not isinstance(body, dict) or "response" not in body:
        raise ModelError("the answer has no response")
    return str(body["response"])


def streamed(lines: Iterable[str | bytes], cancelled: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """The pieces of an answer that comes as one JSON object a line; lines that aren't one are passed over, an
    error raises, and the stream ends when it says so or is cancelled."""
    for line in lines:
        if cancelled():
            return
        try:
            item = json.loads(line)
        except ValueError:
            continue
        if not isinstance(item, dict):
            continue
        if item.get("error"):
            raise ModelError(str(item["error"]))
        if item.get("response"):
            yield str(item["response"])
        if item.get("done"):
            return


def complete(rows: DataFrame, prompt_col: str, model, out: str = "answer", form: str | None = None, slots: int | None = None) -> DataFrame:
    """``rows`` with the model's answer to each prompt, and error: the reason where a call failed, whose answer is null.

    ``model`` has generate(prompt, form) -> str and travels to the executors. A null prompt is not asked. At most
    ``slots`` calls run at once, if given: as many tasks ask.
    """
    rows = rows.drop(out, "error")
    names, at = [*rows.columns, out, "error"], rows.columns.index(prompt_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` string", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column(at).to_pylist():
                answer = error = None
                if prompt is not None:
                    try:
                        answer = model.generate(prompt, form)
                    except Exception as e:  # one failed call must not fail the others
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=names)

    return (rows.repartition(slots) if slots else rows).mapInArrow(run, schema)


def ask(prompts: DataFrame, model, slots: int | None = None) -> DataFrame:
    """(question_id, answer, error) for ``prompts`` (question_id, prompt), answers without white space at their ends."""
    done = complete(prompts.select("question_id", "prompt"), "prompt", model, "answer", slots=slots)
    return done.select("question_id", stripped(done["answer"]).alias("answer"), "error")


def ask_stream(prompt: str, model, cancelled: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """The pieces of the model's answer to one prompt."""
    for piece in model.stream(prompt):
        if cancelled():
            return
        yield piece
