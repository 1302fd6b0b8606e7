"""Quotation linking and reply-ordered conversations without quotes, in DataFrame functions only.

Each line's quote level is the number of > marks before it; a passage is a run of lines of one level.
Passages, their paragraphs and their lines are normalised (lower case, white space as one space) and
hashed. What a message says itself (level 0) is listed by hash with the first message that said it; quoted
units join that list, one row a hash, so repeated lines don't multiply. A message replies to the origin of
its shallowest linked quote; threads are resolved by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stage
from lattica.llm.sharding import prefix_sums

#: Marks before a quoted line, and the line that introduces a quote. Fixed values.
MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
INTRODUCTION = r"(?i)^.{0,200}\b(wrote|schrieb|écrit|escribió)[^\n]{0,80}:\s*$"
_WHOLE, _PARAGRAPH, _LINE = 3, 2, 1
#: Conversations whose names may be broadcast.
BROADCAST_ROWS = 500_000


def _norm(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parse(messages: DataFrame) -> DataFrame:
    """``messages`` (conv, turn, text) with lines: array of (level, text without marks), and own: the text at
    level 0 without lines that only introduce a quote. Staged, so that later steps read and don't repeat it."""
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("text")
        ),
    )
    split = stage(messages.withColumn("lines", lines).drop("text"), "lines")
    own = F.expr(f"filter(lines, (x, i) -> x.level = 0 and not (x.text rlike r'{INTRODUCTION}' and coalesce(get(lines, i + 1).level, 0) > 0))")
    plain = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    return split.withColumn("own", F.when(~F.exists("lines", lambda x: x["level"] > 0), plain).otherwise(F.trim(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"))))


def passages(parsed: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, text): runs of lines of one level, numbered from 0 in each message."""
    edges = "filter(sequence(0, size(lines)), i -> i = 0 or i = size(lines) or lines[i].level <> lines[i - 1].level)"
    runs = parsed.select("conv", "turn", "lines", F.expr(edges).alias("edges"))
    spans = runs.select("conv", "turn", "lines", F.posexplode(F.expr("zip_with(slice(edges, 1, size(edges) - 1), slice(edges, 2, size(edges) - 1), (a, b) -> struct(a, b))")).alias("passage", "s"))
    own = spans.select("conv", "turn", "passage", F.expr("slice(lines, s.a + 1, s.b - s.a)").alias("l"))
    return own.select("conv", "turn", "passage", F.col("l")[0]["level"].alias("level"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def units(rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (text and others) for each distinct unit: grain, size and hash. Blank units are left out."""
    keep = [c for c in rows.columns if c != "text"]
    text = F.col("text")
    parts = F.array_distinct(F.concat(
        F.array(F.struct(F.lit(_WHOLE).alias("grain"), _norm(text).alias("t"))),
        F.transform(F.split(text, r"\n\s*\n"), lambda x: F.struct(F.lit(_PARAGRAPH).alias("grain"), _norm(x).alias("t"))),
        F.transform(F.split(text, "\n"), lambda x: F.struct(F.lit(_LINE).alias("grain"), _norm(x).alias("t"))),
    ))
    return rows.select(*keep, F.explode(parts).alias("u")).filter("u.t <> ''").select(*keep, "u.grain", F.length("u.t").alias("size"), F.sha2("u.t", 256).alias("hash"))


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, passage, level, origin): every quoted passage that has any text, with the turn of the
    message that first said it, its largest known paragraph or its largest known line, earlier than the
    quoting message in the same conversation; origin is null where none did."""
    cut = stage(passages(parsed), "passages")
    said = cut.filter("level = 0").select("conv", "turn", "text").unionByName(parsed.select("conv", "turn", F.col("own").alias("text")))
    quoting = stage(cut.filter("level > 0").select(F.col("conv").alias("of")).distinct(), "quoting")  # others need no list
    some = F.broadcast(quoting) if quoting.count() <= BROADCAST_ROWS else quoting
    said = said.join(some, F.col("conv").eqNullSafe(F.col("of")), "left_semi")
    first = units(said).groupBy("conv", "hash").agg(F.min("turn").alias("origin"))
    quoted = units(cut.filter("level > 0"))
    q, f = quoted.alias("q"), first.alias("f")
    found = q.join(f, F.col("q.conv").eqNullSafe(F.col("f.conv")) & (F.col("q.hash") == F.col("f.hash")), "left")
    origin = F.when(F.col("f.origin") < F.col("q.turn"), F.struct(F.col("q.grain"), F.col("q.size"), (-F.col("f.origin")).alias("early")))
    best = found.groupBy("q.conv", "q.turn", "q.passage", "q.level").agg(F.max(origin).alias("best"))
    return best.select("conv", "turn", "passage", "level", (-F.col("best.early")).alias("origin"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) for ``replies`` (conv, turn, parent, unique by conv and turn, parent < turn)."""
    now = stage(replies.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = now.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        now = stage(step.select("conv", "turn", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``messages``, the text without quotes (line ends as \\n; unchanged where
    nothing is quoted), with parent (turn replied to), thread
    (turn of the message at its start), depth (0 there), position (gapless from 0 in the conversation), and
    quoted and linked (passages).

    A conversation lists its threads by their first turn, and a thread its messages by turn: as a reply
    quotes an earlier turn, it follows what it replies to. The parent is the origin of the shallowest
    linked quote, the latest if several; a message without linked quotes starts a thread. A null text counts
    as empty and stays null; null conversations form one; a message without turn links to nothing and comes
    first. Rows of one conversation and turn count as one message for links, and each has its place. Input
    columns named like an added one are replaced.
    """
    added = ["parent", "thread", "depth", "position", "quoted", "linked"]
    messages = messages.drop(*added)
    rest = [c for c in messages.columns if c not in (conv_col, turn_col, text_col)]
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"), F.col(text_col).isNull().alias("none"), F.struct(turn_col, *rest).alias("row"))
    parsed = parse(base)
    links = stage(quote_links(parsed.filter("turn is not null")), "links")
    counts = links.groupBy("conv", "turn").agg(
        F.count("*").alias("quoted"), F.count("origin").alias("linked"),
        F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("l"), "origin")))["origin"].alias("parent"),
    )
    counts = stage(counts, "counts")
    deep = threads(counts.filter("parent is not null").select("conv", "turn", "parent"))
    m = parsed.select("conv", "turn", "none", "row", "own").alias("m")
    on = lambda a: F.col("m.conv").eqNullSafe(F.col(f"{a}.conv")) & (F.col("m.turn") == F.col(f"{a}.turn"))
    joined = m.join(counts.alias("c"), on("c"), "left").join(deep.alias("d"), on("d"), "left").select(
        "m.conv", "m.turn", "m.none", "m.row", "m.own", "c.parent", F.coalesce("d.root", "m.turn").alias("thread"), F.coalesce("d.depth", F.lit(0)).alias("depth"),
        F.coalesce("c.quoted", F.lit(0)).alias("quoted"), F.coalesce("c.linked", F.lit(0)).alias("linked"), F.lit(1).cast("long").alias("one"),
    )
    placed = stage(prefix_sums(joined, ["conv", "thread", "turn"], "one"), "placed")
    start = stage(placed.groupBy("conv").agg(F.min("rows_before").alias("start")).withColumnRenamed("conv", "of"), "starts")  # staged, so that Spark can split a hot conversation
    out = placed.join(start, F.col("conv").eqNullSafe(F.col("of"))).withColumn("position", F.col("rows_before") - F.col("start"))
    text = F.when(~F.col("none"), F.col("own"))
    pick = {conv_col: F.col("conv"), text_col: text}
    return out.select(*(pick.get(c, F.col("row")[c]).alias(c) for c in messages.columns), *added)
