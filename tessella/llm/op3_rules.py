"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every metric is a built-in expression over the text's array of words, so a scan, one projection and nothing else runs:
no shuffle, no Python. A rule is a row of the table (name, metric, least, most); ``compile_rules`` turns the table into
the boolean columns of that projection. Edge cases: a null or empty text has no words and fails the base rule; ratios
of a text without words are 0; texts are read whole, however long; repeated rows are judged row by row; other columns
of the input are neither read nor returned, so their names cannot clash. Windows are compared by 64-bit hashes of their
words: two unlike windows of one text count as equal by a chance of one in 2 ** 64 a pair.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auch auf das dem den der des die ein eine einer für im in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no o para por que se su un una y"
).split()


class Rule(NamedTuple):
    """A text passes if ``least <= metric <= most``; None is no bound."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: The production table. Bounds leave prose of any of the languages alone.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("mean_word", "word_chars / n_words", 2.0, 16.0),
    Rule("symbols", "n_symbols / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.04, None),
    Rule("dup_lines", "n_dup_lines / n_lines", None, 0.35),
    Rule("repeats", "n_repeat_words / n_words", None, 0.5),
)


def _spelt(stop_words: list[str]) -> list[str]:
    """The words as they stand in prose: lower case or capitalised, alone or before a comma or full stop."""
    return [x + end for w in dict.fromkeys(stop_words) for x in (w, w.capitalize()) for end in ("", ",", ".")]


def _let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


#: Low bits of a packed window: its place in the text.
PLACE = (1 << 24) - 1


def _repeat_words(df: DataFrame) -> DataFrame:
    """df with ``n_repeat_words`` in place of its ``_words``: words that lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash of their words. The high bits of the hash and the place are packed into one
    long, so that a primitive sort brings equal windows together; neighbours are then compared by the full hash. Where
    high bits clash, or a text has more words than places, the full hashes are sorted instead. Each step is a
    projection of its own: generated code then runs it once.
    """
    n, h, win, packed = F.col("n_words"), F.col("_h"), F.col("_win"), F.col("_packed")
    pairs = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(h, 3, F.size(h)), lambda ab, c: F.xxhash64(ab, c))
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    df = df.withColumn("_win", F.slice(windows, 1, F.greatest(F.size(h) - 2, F.lit(0)))).drop("_h")
    df = df.withColumn("_packed", F.sort_array(F.transform(win, lambda x, i: x.bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long")))))
    beside = F.zip_with(packed, F.slice(packed, 2, F.size(packed)), lambda a, b: F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(~PLACE)) == 0, F.array(a.bitwiseAND(F.lit(PLACE)), b.bitwiseAND(F.lit(PLACE)))))
    df = df.withColumn("_twice", F.filter(beside, lambda x: x.isNotNull())).drop("_packed")
    clash = (n > PLACE) | F.exists("_twice", lambda x: win[x[0].cast("int")] != win[x[1].cast("int")])

    def slowly(s: Column) -> Column:
        return F.filter(F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda x: x.isNotNull())

    ordered = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("_starts", F.flatten(F.when(clash, _let(ordered, slowly)).otherwise(F.col("_twice"))))
    covered = F.flatten(F.transform(F.array_distinct("_starts"), lambda i: F.array(i, i + 1, i + 2)))
    return df.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("_win", "_twice", "_starts")


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """id_col and the counts that rules are written in; one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col), text.alias("_text"), F.array_remove(F.split(text, GAP), "").alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = _spelt(stop_words)
    counted = split.select(
        F.col(id_col), "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.size(F.filter(F.col("_words"), lambda w: w.isin(*stops))).cast("long").alias("n_stop_words"),
    ).select("*", F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")).drop("_lines")
    return _repeat_words(counted)


def compile_rules(rules: tuple[Rule, ...]) -> list[Column]:
    """One boolean column per rule: whether a row passes."""
    out = []
    for r in rules:
        top, _, below = (x.strip() for x in r.metric.partition("/"))
        value = F.col(top).cast("double")
        if below:
            value = F.when(F.col(below) > 0, value / F.col(below)).otherwise(F.lit(0.0))
        ok = F.lit(True)
        if r.least is not None:
            ok &= value >= F.lit(float(r.least))
        if r.most is not None:
            ok &= value <= F.lit(float(r.most))
        out.append(ok.alias(f"ok_{r.name}"))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics, one boolean per rule (``ok_<name>``) and ``passed``: all rules hold."""
    judged = metrics(docs, id_col, text_col).select("*", *compile_rules(rules))
    passed = F.lit(True)
    for r in rules:
        passed &= F.col(f"ok_{r.name}")
    return judged.withColumn("passed", passed)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents with the base counts, the base verdict and the verdict of the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
        base.alias("base_failed"), (~base & F.col("passed")).alias("kept"), *[f"ok_{r.name}" for r in RULES],
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in _spelt(STOP_WORDS))
    checks = []
    for r in RULES:
        top, _, below = (x.strip() for x in r.metric.partition("/"))
        value = f"(CASE WHEN {below} > 0 THEN {top}::DOUBLE / {below} ELSE 0.0 END)" if below else f"{top}::DOUBLE"
        bounds = [f"{value} {op} {float(x)}" for op, x in ((">=", r.least), ("<=", r.most)) if x is not None]
        checks.append(f"({' AND '.join(bounds)}) AS ok_{r.name}")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
        len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (doc_id)),
k AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {", ".join(checks)} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
  (NOT base_failed AND {" AND ".join(f"ok_{r.name}" for r in RULES)}) AS kept, {", ".join(f"ok_{r.name}" for r in RULES)}
FROM k"""
