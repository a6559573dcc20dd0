"""Top-k search, items, comparison. A chunk table has row, chunk_id, path, locator, text, start_line, end_line, heading,
deleted and vec; functions take and return DataFrames, the item to compare with is a small driver object."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import vectors as V


class EngineError(ValueError):
    """A request that cannot be met; the message says why."""


@dataclass
class Item:
    """What a reference to a chunk or file resolves to; rows: the chunk's, none of a file's."""

    kind: str
    vec: list[float]
    rows: list[int]
    path: str
    label: str


def _positive(name: str, value: int) -> int:
    if value < 1:
        raise EngineError(f"{name} must be at least 1")
    return value


def alive(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~F.col("deleted")) if "deleted" in chunks.columns else chunks


def hit(score: Column | None, snip: int, columns: list[str]) -> list[Column]:
    """The columns of a result row: score to four places, address, text cut to snip characters."""
    out = [] if score is None else [F.round(score, 4).alias("score")]
    out += [F.col(c) for c in ("chunk_id", "path", "locator", "heading") if c in columns]
    return out + ([T.snippet(F.col("text"), snip).alias("text")] if "text" in columns else [])


#: Winners up to which their rows are asked for by number, which the scan can skip by; more are joined.
NAMED_ROWS = 1000


def scores(rows: DataFrame, query, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """(row, path, _score): inner product of every row's vector with a vector, in double precision.

    A task multiplies its Arrow batches as matrices, row by row in one order, so equal vectors get equal scores. k: of each
    batch only the rows that reach its k-th best score are returned; ties are.
    """
    q = np.asarray(query, np.float64)

    def run(batches):
        for b in batches:
            m = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(q))
            s = np.einsum("ij,j->i", m, q, dtype=np.float64)
            keep = np.ones(len(s), bool) if min_score is None else s >= min_score
            if k is not None and len(s) > k:
                keep &= s >= np.partition(s, len(s) - k)[len(s) - k]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(s[keep])], ["row", "path", "_score"])

    kinds = dict(rows.dtypes)
    return rows.select("row", "path", "vec").mapInArrow(run, f"row {kinds['row']}, path {kinds['path']}, _score double")


def ranked(chunks: DataFrame, query, k: int = 10, min_score: float | None = None, path_glob: str | None = None, group_by_file: bool = False, exclude_rows: list[int] | None = None, exclude_path: str | None = None, snip: int = 300) -> DataFrame:
    """The k chunks of greatest inner product with a vector, best first, ties by row.

    Filters come before scoring and reach the scan; what is ranked carries only row, path and score. Other columns are
    fetched for the k winners alone: these are found first (k rows reach the driver) and asked for by number.
    """
    _positive("k", k)
    rows = alive(chunks)
    if path_glob:
        rows = rows.filter(T.matches_glob(F.col("path"), path_glob))
    if exclude_path is not None:
        rows = rows.filter(F.col("path") != exclude_path)
    if exclude_rows:
        rows = rows.filter(~F.col("row").isin(*exclude_rows))
    scored = scores(rows, query, None if group_by_file else k, min_score)
    if group_by_file:
        best = scored.groupBy("path").agg(F.max(F.struct("_score", (-F.col("row")).alias("r"))).alias("m"))
        scored = best.select((-F.col("m.r")).alias("row"), "path", F.col("m._score").alias("_score"))
    top = scored.orderBy(F.desc("_score"), "row").limit(k)
    if any(c in chunks.columns for c in ("chunk_id", "locator", "heading", "text")):
        rest = rows.drop("vec", "path")
        if k <= NAMED_ROWS:
            found = top.collect()
            rest = rest.filter(F.col("row").isin(*[r["row"] for r in found]))
            top = chunks.sparkSession.createDataFrame(found, top.schema)
        top = rest.join(top, "row")
    return top.orderBy(F.desc("_score"), "row").select("row", *hit(F.col("_score"), snip, chunks.columns))


def search(chunks: DataFrame, query_vec, **options) -> DataFrame:
    """Chunks for an embedded query; options as in ``ranked``."""
    return ranked(chunks, query_vec, **options)


def at_line(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """The chunk of a file whose lines cover one, the narrowest first."""
    cover = alive(chunks).filter((F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    return cover.orderBy(F.col("end_line") - F.col("start_line"), "row").limit(1)


def file_vectors(chunks: DataFrame) -> DataFrame:
    """(path, vec, items): the normalised mean of each file's chunk vectors."""
    return V.group_vectors(alive(chunks), "path")


def resolve(chunks: DataFrame, ref: str) -> Item:
    """An item from a chunk id, path:line or path, tried in this order."""
    rows = alive(chunks)
    if got := rows.filter(F.col("chunk_id") == ref).orderBy("row").select("row", "path", "locator", "chunk_id", "vec").limit(1).collect():
        return _chunk(got[0])
    is_file = not rows.filter(F.col("path") == ref).isEmpty()
    m = re.fullmatch(r"(.*):(\d+)", ref, re.DOTALL)
    if m and not is_file:
        path, line = m[1].removeprefix("./"), int(m[2])
        if got := at_line(rows, path, line).select("row", "path", "locator", "chunk_id", "vec").collect():
            return _chunk(got[0])
        if rows.filter(F.col("path") == path).isEmpty():
            raise EngineError(f"'{path}' is not in the index")
        raise EngineError(f"no chunk of '{path}' covers line {line}")
    path = ref if is_file else ref.removeprefix("./")
    own = rows.filter(F.col("path") == path)
    if got := file_vectors(own).collect():
        return Item("file", list(got[0]["vec"]), [], path, path)
    raise EngineError(f"'{ref}' is no chunk id, file or file:line of the index")


def _chunk(r) -> Item:
    return Item("chunk", list(r["vec"]), [r["row"]], r["path"], f"{r['path']} {r['locator']} [{r['chunk_id']}]")


def similar(chunks: DataFrame, ref: str, k: int = 10, group_by_file: bool = False, path_glob: str | None = None, snip: int = 300) -> DataFrame:
    """Chunks most similar to an item: without the chunk itself, or without any chunk of the file."""
    item = resolve(chunks, ref)
    own = {"exclude_rows": item.rows} if item.kind == "chunk" else {"exclude_path": item.path}
    return ranked(chunks, item.vec, k, group_by_file=group_by_file, path_glob=path_glob, snip=snip, **own)


def compare(chunks: DataFrame, a: str, b: str) -> dict:
    """Cosine of two items; for two files that of their mean vectors (``best_pairs`` gives their chunks)."""
    left, right = resolve(chunks, a), resolve(chunks, b)
    out = {"a": left.label, "b": right.label, "score": round(sum(x * y for x, y in zip(left.vec, right.vec, strict=True)), 4)}
    return out | ({"score_kind": "cosine of mean chunk vectors"} if left.kind == right.kind == "file" else {})


def best_pairs(chunks: DataFrame, a: str, b: str, pairs: int = 5) -> DataFrame:
    """(a, b, score): the most similar chunk pairs of two files, by blocks."""
    from tessella.operators import blocks

    _positive("pairs", pairs)
    rows = alive(chunks)
    left, n_left = blocks.packed(rows.filter(F.col("path") == a), "row", "vec")
    right, n_right = blocks.packed(rows.filter(F.col("path") == b), "row", "vec")
    return blocks.best_between(left, n_left, right, n_right, pairs)


def compare_texts(embedder, a: str, b: str) -> float:
    """Cosine of two texts, both embedded as documents."""
    x, y = embedder.encode([a, b])
    return round(float(x @ y), 4)


