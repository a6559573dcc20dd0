"""Blocks of vectors: n x n similarity without collecting, broadcasting or cross joining a table.

Rows are dealt into blocks of fixed size by a hash, each block one row with its matrix as bytes. A row block meets the
column blocks in runs: a task holds one row block and one column block at a time and keeps what it needs per row
(matches, or the k best so far), in tiles of TILE columns. With n rows there are n / SIZE blocks, so a task's memory does
not grow with n; what is shuffled is n * n / SIZE vectors. Vectors travel as they are stored (32 or 64 bits) and are
multiplied in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import Scratch

SIZE, RUN, TILE = 8192, 8, 1024
BLOCK = "block long, wide boolean, ids binary, groups binary, matrix binary"


def _pack(wide: bool):
    """Rows (block, id, grp, vec) sorted by block to one row a block."""

    def run(batches):
        now, parts = None, []

        def out():
            ids, groups, vecs = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([wide]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, groups, vecs))], ["block", "wide", "ids", "groups", "matrix"])

        for b in batches:
            block, ids, groups = (b.column(i).to_numpy() for i in range(3))
            vecs = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64 if wide else np.float32).reshape(len(ids), -1)
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for x, y in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[x] != now and parts:
                    yield out()
                    parts = []
                now = block[x]
                parts.append((ids[x:y], groups[x:y], vecs[x:y]))
        if parts:
            yield out()

    return run


def packed(df: DataFrame, id_col: str, vec_col: str, group_col: str | None = None, size: int | None = None, n: int | None = None) -> tuple[DataFrame, int]:
    """Blocks of df and their number. group_col: rows of one group get one number."""
    n = df.count() if n is None else n
    count = max(1, -(-n // (size or SIZE)))
    group = F.xxhash64(group_col) if group_col else F.lit(0).cast("long")
    rows = df.select(F.pmod(F.xxhash64(id_col), F.lit(count)).alias("block"), F.col(id_col).cast("long").alias("id"), group.alias("grp"), F.col(vec_col).alias("vec"))
    dealt = rows.repartition(count, "block").sortWithinPartitions("block", "id")
    wide = dict(df.dtypes)[vec_col] != "array<float>"
    return Scratch(df.sparkSession).keep(dealt.mapInArrow(_pack(wide), BLOCK)), count


def _matrix(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide, ids, groups, matrix = row
    ids = np.frombuffer(ids, np.int64)
    m = np.frombuffer(matrix, np.float64 if wide else np.float32).reshape(len(ids), -1)
    return ids, np.frombuffer(groups, np.int64), m.astype(np.float64)


def _rows(b: pa.RecordBatch):
    """A batch's rows one at a time, so that one block is a Python object, not all of them."""
    for i in range(b.num_rows):
        yield tuple(b.column(c)[i].as_py() for c in range(b.num_columns))


def _streamed(start, step, finish):
    """Runs (row block, run, kind, ...) of one row block (kind 0) and its column blocks: start, step for each, finish."""

    def run(batches):
        key, state = None, None
        for b in batches:
            for rb, part, kind, other, *row in _rows(b):
                if (rb, part) != key:
                    if state is not None:
                        yield from finish(state)
                    key, state = (rb, part), start(rb, _matrix(row))
                if kind == 1:
                    ids, groups, m = _matrix(row)
                    for at in range(0, len(ids), TILE):
                        yield from step(state, other, (ids[at : at + TILE], groups[at : at + TILE], m[at : at + TILE]))
        if state is not None:
            yield from finish(state)

    return run


def _met(left: DataFrame, n_left: int, right: DataFrame, n_right: int, ordered: bool) -> DataFrame:
    """Each left block with the right blocks of each run; ordered: only right blocks from its own number on."""
    runs = max(1, -(-n_right // RUN))
    rows = left.select(F.col("block").alias("rb"), F.expr(f"explode(sequence(0L, {runs - 1}L))").alias("part"), F.lit(0).alias("kind"), "block", "wide", "ids", "groups", "matrix")
    span = "explode(sequence(0L, block))" if ordered else f"explode(sequence(0L, {n_left - 1}L))"
    cols = right.select(F.expr(span).alias("rb"), F.pmod("block", F.lit(runs)).alias("part"), F.lit(1).alias("kind"), "block", "wide", "ids", "groups", "matrix")
    return rows.unionByName(cols).repartition(min(n_left * runs, 100_000), "rb", "part").sortWithinPartitions("rb", "part", "kind", "block")


def pairs_above(df: DataFrame, id_col: str, vec_col: str, threshold: float, group_col: str | None = None) -> DataFrame:
    """(a, b, score), a < b: pairs of inner product at least threshold, of different groups if group_col is given."""
    blocks, n = packed(df, id_col, vec_col, group_col)

    def step(state, other, cols):
        block, (ids, groups, m) = state
        oids, ogroups, om = cols
        s = m @ om.T
        i, j = np.nonzero(s >= threshold)
        if block == other:  # a block against itself: each pair once
            keep = ids[i] < oids[j]
            i, j = i[keep], j[keep]
        if group_col:
            keep = groups[i] != ogroups[j]
            i, j = i[keep], j[keep]
        a, b = ids[i], oids[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s[i, j])], ["a", "b", "score"])

    met = _met(blocks, n, blocks, n, ordered=True)
    return met.mapInArrow(_streamed(lambda block, rows: (block, rows), step, lambda state: ()), "a long, b long, score double")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k greatest scores and their ids, in order; ties go to the smaller id."""
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    i, j = np.nonzero(score >= least[:, None])
    s, d = score[i, j], ids[i, j]
    o = np.lexsort((d, -s, i))
    first = np.searchsorted(i, np.arange(len(score)))  # i is sorted, and stays so in the order o
    take = o[(first[:, None] + np.arange(k)).ravel()]
    return s[take].reshape(-1, k), d[take].reshape(-1, k)


def nearest(df: DataFrame, id_col: str, vec_col: str, k: int, group_col: str | None = None) -> DataFrame:
    """(id, rank, other, score): the k rows of greatest inner product to each row, itself (and its group) excluded."""
    blocks, n = packed(df, id_col, vec_col, group_col)

    def start(block, rows):
        m = len(rows[0])
        return {"rows": rows, "score": np.full((m, 0), 0.0), "id": np.zeros((m, 0), np.int64)}

    def step(state, other, cols):
        ids, groups, m = state["rows"]
        oids, ogroups, om = cols
        s = m @ om.T
        s[ids[:, None] == oids[None, :]] = -np.inf
        if group_col:
            s[groups[:, None] == ogroups[None, :]] = -np.inf
        if state["score"].shape[1] == k:  # only what reaches the k-th best can change a row's list
            i, j = np.nonzero(s >= state["score"][:, -1:])
            rows = np.unique(i)
            if not len(rows):
                return ()
        else:
            rows = np.arange(len(ids))
        score = np.concatenate([state["score"][rows], s[rows]], axis=1)
        other_id = np.concatenate([state["id"][rows], np.broadcast_to(oids, (len(rows), len(oids)))], axis=1)
        score, other_id = _best(score, other_id, min(k, score.shape[1]))
        if len(rows) == len(ids):
            state["score"], state["id"] = score, other_id
        else:
            state["score"][rows], state["id"][rows] = score, other_id
        return ()

    def finish(state):
        i, j = np.nonzero(np.isfinite(state["score"]))
        yield pa.RecordBatch.from_arrays([pa.array(state["rows"][0][i]), pa.array(state["id"][i, j]), pa.array(state["score"][i, j])], ["id", "other", "score"])

    found = _met(blocks, n, blocks, n, ordered=False).mapInArrow(_streamed(start, step, finish), "id long, other long, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("id", "rank", "other", "score")


def best_between(left: DataFrame, n_left: int, right: DataFrame, n_right: int, k: int) -> DataFrame:
    """(a, b, score): the k pairs of greatest inner product between two tables' blocks."""

    def step(state, other, cols):
        ids, _, m = state
        oids, _, om = cols
        s = (m @ om.T).ravel()
        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        at = np.flatnonzero(s >= least)
        if not len(at):
            return
        yield pa.RecordBatch.from_arrays([pa.array(ids[at // len(oids)]), pa.array(oids[at % len(oids)]), pa.array(s[at])], ["a", "b", "score"])

    met = _met(left, n_left, right, n_right, ordered=False)
    return met.mapInArrow(_streamed(lambda block, rows: rows, step, lambda state: ()), "a long, b long, score double").orderBy(F.desc("score"), "a", "b").limit(k)
