"""Tokens of a sentence by rule: words, marks and single signs, with the white space after each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\[(?:MATH|EQUATION|CITATION|REF)\]|[\p{L}\p{N}]+(?:['’][\p{L}]+)?|[^\s\p{L}\p{N}]"


def token_texts(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))


def tokens(x: Column | str) -> Column:
    """``array<struct<text, ws, start, stop>>``; offsets count from 0 in characters, ``ws`` is the gap to the next token."""
    x = F.col(x) if isinstance(x, str) else x
    raw = F.regexp_extract_all(x, F.lit(f"((?:{TOKEN})\\s*)"), F.lit(1))
    lead = F.length(x) - F.length(F.regexp_replace(x, "^\\s+", ""))
    ends = F.transform(raw, lambda _, i: F.aggregate(F.slice(raw, 1, i), lead, lambda n, t: n + F.length(t)))
    return F.transform(
        F.arrays_zip(raw.alias("raw"), ends.alias("at")),
        lambda z: F.struct(
            F.rtrim(F.regexp_replace(z["raw"], "\\s+$", "")).alias("text"), F.regexp_extract(z["raw"], "(\\s*)$", 1).alias("ws"), z["at"].alias("start"),
            (z["at"] + F.length(F.regexp_replace(z["raw"], "\\s+$", ""))).alias("stop"),
        ),
    )


def untokenize(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.trim(F.array_join(F.transform(ts, lambda t: F.concat(t["text"], t["ws"])), ""))


def span(ts: Column | str, start: int, length: int) -> Column:
    """Some tokens in a row."""
    return F.slice(F.col(ts) if isinstance(ts, str) else ts, start + 1, length)
