"""Scalar text functions as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that ask about the whole collection, and what names a file.
GLOBAL_WORDS = ("theme", "themes", "overview", "summarize", "summary", "main", "overall", "across", "everything", "codebase")
FILE_NAME = r"\b[\w-]+\.(?:md|py|tsx?|jsx?|json|ya?ml|toml|go|rs|txt)\b"
# Unicode's white space, and the four separators that text functions of Python count to it.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits, runs of anything else as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def identifiers(text: Column) -> Column:
    """Distinct identifiers in order: words with an underscore, or a lower-case letter before an upper-case one."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (w.contains("_") | w.rlike("[a-z][A-Z]"))))


def heuristic_route(question: Column) -> Column:
    """'local' if the question names a file, else 'global' if it has a word about the whole, else 'local'."""
    lower = F.lower(question)
    words = F.regexp_extract_all(lower, F.lit("([a-z]+)"), 1)
    known = F.array(*(F.lit(w) for w in GLOBAL_WORDS))
    return F.when(lower.rlike(FILE_NAME), "local").when(F.arrays_overlap(words, known), "global").otherwise("local")


def prepared_for_embedding(text: Column, limit: int) -> Column:
    """Stripped and cut to ``limit`` characters; null if nothing is left."""
    bare = stripped(text)
    return F.when(F.length(bare) > 0, F.substring(bare, 1, limit))


def mentions(text: Column, name: Column) -> Column:
    """Whether ``name`` stands in ``text`` between word boundaries, in any case."""
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?iu)\b"), quoted, F.lit(r"\b")))


def none_as_null(text: str) -> str:
    """JSON-like text in which Python's None, where a value stands, is null: after a colon, comma or opening
    bracket and before a comma or closing bracket, white space aside."""
    out, done, size = [], 0, len(text)
    at = text.find("None")
    while at >= 0:
        left, right = at - 1, at + 4
        while left >= 0 and text[left].isspace():
            left -= 1
        while right < size and text[right].isspace():
            right += 1
        if left >= 0 and text[left] in ":,[" and right < size and text[right] in ",}]":
            out += [text[done:at], "null"]
            done = at + 4
        at = text.find("None", at + 4)
    return "".join([*out, text[done:]])


def recover_json(text: str | None):
    """The value of a model's answer by the first reading that parses, or None.

    Readings are parts of the text, as they are or with None as null; their order is the contract: the text,
    what follows a leading {} in both ways, the part from the first { to the last }, and then the text and
    that part with None as null.
    """
    if not text:
        return None
    bare, first, last = text.strip(), text.find("{"), text.rfind("}")
    after = bare[2:].strip() if bare.startswith("{}") else ""
    block = text[first : last + 1] if 0 <= first < last else ""
    for part, reading in ((text, str), (after, str), (after, none_as_null), (block, str), (text, none_as_null), (block, none_as_null)):
        try:
            return json.loads(reading(part))
        except ValueError:  # an empty part too
            continue
    return None
