"""Operators over all pairs: duplicates, neighbours, outliers; at chunk or file level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import blocks
from tessella.operators.search import EngineError, _positive, alive, file_vectors


def level_vectors(chunks: DataFrame, level: str) -> DataFrame:
    """(item long, path, vec): chunks by row, or files by the order of their paths' hash."""
    if level == "chunk":
        return alive(chunks).select(F.col("row").cast("long").alias("item"), "path", "vec")
    if level == "file":
        return file_vectors(chunks).select(F.xxhash64("path").alias("item"), "path", "vec")
    raise EngineError("level must be 'chunk' or 'file'")


def dupes(chunks: DataFrame, threshold: float, across_files_only: bool = False) -> DataFrame:
    """(a, b, score): pairs of chunk rows a < b of cosine at least threshold; all of them, unsorted and unrounded."""
    return blocks.pairs_above(alive(chunks), "row", "vec", threshold, "path" if across_files_only else None)


def dupes_report(chunks: DataFrame, threshold: float, across_files_only: bool = False, limit: int = 50, snip: int = 300) -> DataFrame:
    """The limit best pairs (all if limit <= 0) with both chunks' identities and ``total_pairs``."""
    pairs = dupes(chunks, threshold, across_files_only)
    total = pairs.count()
    ordered = pairs.orderBy(F.desc("score"), "a", "b")
    shown = ordered.limit(limit) if limit > 0 else ordered
    who = alive(chunks).select("row", F.struct(*[F.col(c) for c in ("chunk_id", "path", "locator", "heading") if c in chunks.columns], *([T.snippet(F.col("text"), snip).alias("text")] if "text" in chunks.columns else [])).alias("who"))
    out = shown.join(who.select(F.col("row").alias("a"), F.col("who").alias("chunk_a")), "a").join(who.select(F.col("row").alias("b"), F.col("who").alias("chunk_b")), "b")
    return out.select("a", "b", F.round("score", 4).alias("score"), "chunk_a", "chunk_b", F.lit(total).alias("total_pairs")).orderBy(F.desc("score"), "a", "b")


def _checked(items: DataFrame, across_files_only: bool = False) -> int:
    n = items.count()
    if n < 2:
        raise EngineError("at least two items are needed")
    if across_files_only and items.select("path").distinct().limit(2).count() < 2:
        raise EngineError("the index holds a single file: it has no neighbours across files")
    return n


def nearest(chunks: DataFrame, level: str = "chunk", k: int = 10, min_score: float | None = None, across_files_only: bool = False) -> DataFrame:
    """(item, rank, other, score, path, other_path): each item's k nearest, fewer where min_score cuts the list."""
    items = level_vectors(chunks, level)
    across = across_files_only and level == "chunk"
    n = _checked(items, across)
    found = blocks.nearest(items, "item", "vec", min(_positive("k", k), n - 1), "path" if across else None)
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    names = items.select("item", "path")
    return found.withColumnRenamed("id", "item").join(names, "item").join(names.select(F.col("item").alias("other"), F.col("path").alias("other_path")), "other").select("item", "rank", "other", "score", "path", "other_path")


def neighbors(chunks: DataFrame, level: str = "chunk", k: int = 10, min_score: float | None = None, across_files_only: bool = False) -> DataFrame:
    """(item, path, neighbors): every item, with its neighbours (array of score, other, path) best first, maybe none."""
    found = nearest(chunks, level, k, min_score, across_files_only)
    lists = found.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 4).alias("score"), "other", F.col("other_path").alias("path")))).alias("_l"))
    empty = F.array().cast("array<struct<rank:int,score:double,other:bigint,path:string>>")
    return level_vectors(chunks, level).select("item", "path").join(lists, "item", "left").select("item", "path", F.coalesce("_l", empty).alias("neighbors"))


def neighbor_means(chunks: DataFrame, level: str = "chunk", neighbors: int = 5) -> DataFrame:
    """(item, path, mean_neighbor_score): mean similarity to the nearest items."""
    found = nearest(chunks, level, _positive("neighbors", neighbors))
    return found.groupBy("item", "path").agg(F.avg("score").alias("mean_neighbor_score"))


def outliers(chunks: DataFrame, level: str = "chunk", neighbors: int = 5, n: int = 10) -> DataFrame:
    """The n items least similar to their nearest ones, with the median over all items."""
    from tessella.runtime import Scratch

    means = Scratch(chunks.sparkSession).keep(neighbor_means(chunks, level, neighbors))
    median = means.agg(F.median("mean_neighbor_score")).first()[0]
    least = means.orderBy("mean_neighbor_score", "item").limit(_positive("n", n))
    return least.select("item", "path", F.round("mean_neighbor_score", 4).alias("mean_neighbor_score"), F.round(F.lit(median), 4).alias("median_mean_neighbor_score"))
