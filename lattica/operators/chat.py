"""Chat requests: validation, the question, and responses.

messages (conv_id, turn, role, text) and optionally items, array of maps, in place of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import DEFAULT, EngineConfig
from lattica.functions.text import stripped

ROLES = ("system", "user", "assistant")
EMPTY_ANSWER = "No answer."


def flat_content(text: Column, items: Column | None = None) -> Column:
    """The text, or the items' texts joined by a space."""
    if items is None:
        return text
    return F.when(text.isNull(), F.array_join(F.transform(items, lambda m: F.coalesce(m["text"], F.lit(""))), " ")).otherwise(text)


def message_size(text: Column, items: Column | None = None) -> Column:
    """Characters of a text, or of all values of its items."""
    size = F.length(F.coalesce(text, F.lit("")))
    if items is None:
        return size
    of = F.aggregate(items, F.lit(0), lambda a, m: a + F.aggregate(F.map_values(m), F.lit(0), lambda b, v: b + F.length(v)))
    return F.when(text.isNull(), of).otherwise(size)


def first_errors(messages: DataFrame, config: EngineConfig = DEFAULT, has_items: bool = False) -> DataFrame:
    """(conv_id, turn, error) of the first check that fails: message, total, then items, message by message."""
    items = F.col("items") if has_items else None
    sized = messages.withColumn("size", message_size(F.col("text"), items))
    total = F.sum("size").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    many = F.size(items) > config.max_content_items if has_items else F.lit(False)
    error = F.when(F.col("size") > config.max_message_chars, "message").when(total > config.max_total_chars, "total").when(many, "items")
    return sized.select("conv_id", "turn", error.alias("error")).filter("error is not null").groupBy("conv_id").agg(F.min_by("error", "turn").alias("error"), F.min("turn").alias("turn"))


def latest_questions(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, question, status): the last user message, stripped; ok, no_user, empty or too_long."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    last = messages.groupBy("conv_id").agg(F.max_by("text", user).alias("text"), F.max(user).alias("at"))
    question = stripped(F.col("text"))
    status = F.when(F.col("at").isNull(), "no_user").when(F.coalesce(F.length("question"), F.lit(0)) == 0, "empty").when(F.length("question") > config.max_question_chars, "too_long").otherwise("ok")
    return last.withColumn("question", question).select("conv_id", "question", status.alias("status"))


def request_fields(requests: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``requests`` (model, n_messages, roles, mode) with valid."""
    ok = F.length("model").between(1, config.max_model_name_chars) & F.col("n_messages").between(1, config.max_chat_messages)
    ok = ok & F.forall("roles", lambda r: r.isin(*ROLES)) & F.col("mode").isin("auto", "local", "global")
    return requests.withColumn("valid", F.coalesce(ok, F.lit(False)))


def login_fields(logins: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``logins`` (username, password) with valid: each of 1 to as many characters as a model's name may have."""
    ok = F.length("username").between(1, config.max_model_name_chars) & F.length("password").between(1, config.max_model_name_chars)
    return logins.withColumn("valid", F.coalesce(ok, F.lit(False)))


def model_entries(models: DataFrame) -> DataFrame:
    """(model, body): the entry of a list of models in JSON, for ``models`` (model)."""
    return models.select("model", F.to_json(F.struct(F.col("model").alias("id"), F.lit("model").alias("object"), F.lit("local").alias("owned_by"))).alias("body"))


def stream_end(conversations: DataFrame, model: str) -> DataFrame:
    """(conv_id, line): what ends a stream of chunks."""
    choice = F.struct(F.lit(0).alias("index"), F.from_json(F.lit("{}"), "content string").alias("delta"), F.lit("stop").alias("finish_reason"))
    body = F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices")))
    return conversations.select("conv_id", F.concat(F.lit("data: "), body, F.lit("\n\ndata: [DONE]\n\n")).alias("line"))


def responses(answers: DataFrame, model: str) -> DataFrame:
    """(conv_id, body): a completion object in JSON for ``answers`` (conv_id, answer)."""
    content = F.when(F.coalesce(F.col("answer"), F.lit("")) == "", EMPTY_ANSWER).otherwise(F.col("answer"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))
    return answers.select("conv_id", F.to_json(F.struct(F.lit("chat.completion").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices"))).alias("body"))


def stream_chunks(pieces: DataFrame, model: str) -> DataFrame:
    """(conv_id, seq, line): server-sent event lines for ``pieces`` (conv_id, seq, piece)."""
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.col("piece").alias("content")).alias("delta"))
    return pieces.select("conv_id", "seq", F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chat.completion.chunk").alias("object"), F.lit(model).alias("model"), F.array(choice).alias("choices"))), F.lit("\n\n")).alias("line"))
