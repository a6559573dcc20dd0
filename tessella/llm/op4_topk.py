"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Rows are cut into blocks; a block holds, for every dimension, its rows sorted by that component. For a query the lists
are read from the end that the query's sign favours, some ranks deeper each round; rows seen for the first time are
scored in full. The threshold is the score of a row that would stand at the current depth of every list, which no unseen
row can exceed. The search of a block stops when the threshold is below the k-th best score so far, taken over all blocks
that the task has read: the bound is strict, so ties are all seen and go to the smaller id.

A block's lists are sorted once, where it is packed, and travel with it. A query's blocks are met in runs: (query block,
row block) pairs are dealt over tasks, at most RUN row blocks a run, and the k best of each run are merged by a window per
query. The number of runs follows the number of row blocks, so neither side is ever held whole; queries and rows are both
read in blocks of fixed size, and a row block travels once for QUERIES queries.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; components become
floor(scale * x); vectors of other lengths count missing dimensions as 0; scores are exact whole numbers: where float64
could round them, the query's rows are scored in Python's whole numbers, and a score beyond 64 bits is an error; a null id takes no part; a row
with a query's own id is not its candidate; of rows that repeat an id each is a candidate, and such a query is asked
once per distinct vector; fewer candidates than k give all; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.texts import trimmed
from tessella.runtime import Scratch

K, SCALE = 10, 1024
#: Rows of a block, queries of a block, row blocks of a run, ranks of the first round.
ROWS, QUERIES, RUN, DEPTH = 8192, 4096, 16, 64
#: Runs that a query block has at least, if there are as many row blocks: tasks to work on.
RUNS = 64


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) as doubles, of the rows that take part."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = 2.0**52  # from here on doubles are whole numbers
    floor = F.transform(v, lambda x: F.when(F.abs(x * scale) < whole, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return df.filter(ok & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), floor.alias("v"))


def _packed(batches, k: int):
    """(block, vec_id, vec) rows sorted by block and id, to one row a block (block, dim, ids, matrix, sorted) of bytes; sorted:
    the numbers of the block's rows in the order of each component. k: of rows equal in all, so many are kept, as more
    cannot be among the k best; 0 for queries, which need no lists."""
    run, ids, vecs, same = None, [], [], {}

    def out():
        dim = max(map(len, vecs))
        m = np.zeros((len(vecs), dim))
        for i, v in enumerate(vecs):
            m[i, : len(v)] = v
        order = np.argsort(m, axis=0, kind="stable").astype(np.uint32).tobytes() if k else b""
        return pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), m.tobytes(), order))], ["block", "dim", "ids", "matrix", "sorted"])

    for b in batches:
        column = b.column(2)
        flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
        at = at - at[0]
        for i, (block, vec_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if block != run:
                if vecs:
                    yield out()
                run, ids, vecs = block, [], []
            vec = flat[at[i] : at[i + 1]].copy()
            if not ids or vec_id != ids[-1]:
                same = {}
            same[raw] = n = same.get(raw := vec.tobytes(), 0) + 1
            if n <= max(k, 1):
                ids.append(vec_id)
                vecs.append(vec)
    if vecs:
        yield out()


def blocks(rows: DataFrame, size: int, n: int, k: int) -> DataFrame:
    """Rows (vec_id, v) packed into about n / size blocks by a hash of the id and vector: equal shares, whatever the ids."""
    count = max(1, -(-n // size))

    def pack(batches):
        return _packed(batches, k)

    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).alias("block"), "vec_id", "v")
    return dealt.repartition(min(count, 4096), "block").sortWithinPartitions("block", "vec_id").mapInArrow(pack, "block long, dim int, ids binary, matrix binary, sorted binary")


class Lists:
    """A block of rows with its rows sorted by each dimension."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, order: np.ndarray):
        self.ids, self.m, self.order = ids, m, order
        self.sorted = np.take_along_axis(m, self.order, axis=0)
        self.most = np.abs(m).max(axis=0)

    def search(self, query_id: int, q: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """best: (-score, id) of the k best so far, sorted; returned with this block's rows in it."""
        n, dim = self.m.shape
        q = q[:dim] if len(q) >= dim else np.concatenate([q, np.zeros(dim - len(q))])
        if float(np.abs(q) @ self.most) >= 2.0**53:  # float64 would round: every row in whole numbers
            whole = [int(x) for x in q]
            scored = [(-sum(a * int(b) for a, b in zip(whole, row, strict=True)), int(i)) for row, i in zip(self.m.tolist(), self.ids, strict=True)]
            return sorted([*best, *(x for x in scored if x[1] != query_id)])[:k]
        used = np.flatnonzero(q)
        up = q[used] > 0
        seen = np.zeros(n, bool)
        depth, step = 0, DEPTH
        while True:
            end = min(n, depth + step)
            ranks = np.arange(depth, end)
            at = np.where(up, n - 1 - ranks[:, None], ranks[:, None])
            fresh = np.zeros(n, bool)
            fresh[self.order[at, used].ravel() if len(used) else slice(None)] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            scores = self.m[new] @ q
            if len(best) == k:
                hit = scores >= -best[-1][0]
                new, scores = new[hit], scores[hit]
            if len(new) > 4 * k:  # the k best and their ties
                least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                new, scores = new[scores >= least], scores[scores >= least]
            best = sorted([*best, *((-int(s), int(i)) for s, i in zip(scores, self.ids[new], strict=True) if i != query_id)])[:k]
            depth, step = end, step * 2
            if depth >= n or not len(used):
                return best
            edge = self.sorted[np.where(up, n - 1 - depth, depth), used]  # the next rank of each list
            if len(best) == k and edge @ q[used] < -best[-1][0]:
                return best


def _search(k: int):
    def run(batches):
        """Rows (query block, run, kind, block, dim, ids, matrix, sorted) sorted so, queries (kind 0) first."""
        key, queries, best = None, [], []

        def out():
            rows = [(qid, n, -s, i) for n, (qid, _) in enumerate(queries) for s, i in best[n]]
            q, no, s, i = zip(*rows, strict=True) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([(key[0] << 20) + x for x in no], pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], ["query_id", "query", "score", "vec_id"])

        for b in batches:
            for i in range(b.num_rows):
                qb, part, kind, _, dim, ids, matrix, order = (b.column(c)[i].as_py() for c in range(8))
                ids = np.frombuffer(ids, np.int64)
                m = np.frombuffer(matrix, np.float64).reshape(len(ids), dim)
                if (qb, part) != key:
                    if queries:
                        yield out()
                    key, queries, best = (qb, part), [], []
                if kind == 0:
                    queries = list(zip(ids.tolist(), m, strict=True))
                    best = [[] for _ in queries]
                else:
                    lists = Lists(ids, m, np.frombuffer(order, np.uint32).reshape(m.shape).astype(np.int64))
                    for n, (qid, q) in enumerate(queries):
                        best[n] = lists.search(qid, q, k, best[n])
        if queries:
            yield out()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows, ties to the smaller id."""
    scratch = Scratch(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vec_col, scale)
    asked = whole_vectors(queries, id_col, vec_col, scale).distinct()
    n, n_asked = rows.count(), asked.count()
    row_blocks = scratch.keep(blocks(rows, ROWS, n, k))
    query_blocks = scratch.keep(blocks(asked, QUERIES, n_asked, 0))
    parts, asks = max(1, -(-n // ROWS)), max(1, -(-n_asked // QUERIES))
    runs = max(min(parts, RUNS), -(-parts // RUN))
    each = F.expr(f"explode(sequence(0L, {runs - 1}L))")
    left = query_blocks.select(F.col("block").alias("qb"), each.alias("part"), F.lit(0).alias("kind"), "block", "dim", "ids", "matrix", "sorted")
    every = F.expr(f"explode(sequence(0L, {asks - 1}L))")
    right = row_blocks.select(every.alias("qb"), F.pmod("block", F.lit(runs)).cast("long").alias("part"), F.lit(1).alias("kind"), "block", "dim", "ids", "matrix", "sorted")
    met = left.unionByName(right).repartition(min(runs * asks, 100_000), "qb", "part").sortWithinPartitions("qb", "part", "kind", "block")
    found = met.mapInArrow(trimmed(_search(k)), "query_id long, query long, score long, vec_id long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_threshold_topk(spark, sf_dir: str) -> DataFrame:
    """Ten best rows of every query (ids divisible by 100) among all embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
