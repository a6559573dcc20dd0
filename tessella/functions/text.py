"""Text expressions: globs, snippets, ids of chunks. Lines, records, tokens and windows are the readers' and the chunker's."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a word is made of, alike in Spark and DuckDB.
WORD = r"[\p{L}\p{N}_]+"


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regex: * and ? cross slashes, [...] and [!...] are classes."""
    out, rest = [], pattern
    while rest:
        c, rest = rest[0], rest[1:]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := rest.find("]", 2 if rest[:1] == "!" else 1)) > 0:
            inner, rest = rest[:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&"), rest[end + 1 :]
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else ('\\' + inner if inner[0] == '^' else inner)}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c))
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whether the path or its last part matches."""
    rx = glob_regex(pattern)
    return path.rlike(rx) | F.element_at(F.split(path, "/"), -1).rlike(rx)


def snippet(text: Column, n: int) -> Column:
    """At most n characters and an ellipsis; n <= 0 gives all."""
    if n <= 0:
        return text
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r"[\s\x1c-\x1f\x85   -     　]+$", ""), F.lit(" …")))


def chunk_id(path: Column, place: Column, text_sha256: Column) -> Column:
    """Twelve hex digits that depend on file, place and content."""
    return F.substring(F.sha1(F.concat(path, F.lit("\0"), place, F.lit("\0"), text_sha256).cast("binary")), 1, 12)


def unique_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Ids that occur again are hashed anew, once for each earlier occurrence in ``order``."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    again = F.aggregate(F.sequence(F.lit(1), nth), F.col(id_col), lambda h, i: F.when(i == 1, h).otherwise(F.substring(F.sha1(h.cast("binary")), 1, 12)))
    return df.withColumn(id_col, again)
