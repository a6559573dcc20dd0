"""Cosine k-means: centroids are fitted on a sample of bounded size on the driver, then every item is assigned in place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators.search import EngineError
from tessella.operators.similarity import level_vectors

#: Items the centroids are fitted on, items the number of clusters is chosen on, and the largest number tried.
SAMPLE, SEARCH_SAMPLE, MOST = 20_000, 2_000, 15


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=m.copy(), where=length > 0)


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn with probability in proportion to its squared distance to the nearest drawn one."""
    chosen = [int(rng.integers(len(x)))]
    far = np.full(len(x), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, np.clip(2 - 2 * x @ x[chosen[-1]], 0, None))
        weight = far.cumsum()
        at = int(np.searchsorted(weight, rng.random() * weight[-1], "right")) if weight[-1] > 0 else int(rng.integers(len(x)))
        chosen.append(min(at, len(x) - 1))
    return x[chosen]


def fit(x: np.ndarray, k: int, seed: int = 0, restarts: int = 3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(centroids, labels, cost) of the best of some restarts; cost is the sum of 1 - cosine to the own centroid."""
    runs = []
    for start in range(restarts):
        rng = np.random.default_rng(seed + start)
        c, labels = _seeds(x, k, rng), None
        for _ in range(rounds):
            sims = x @ c.T
            new = sims.argmax(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            sums, sizes = np.zeros_like(c), np.bincount(labels, minlength=k)
            np.add.at(sums, labels, x)
            empty = np.flatnonzero(sizes == 0)
            if len(empty):  # the worst-fitting points start anew
                sums[empty] = x[np.argsort(sims.max(axis=1), kind="stable")[: len(empty)]]
            c = _unit(sums)
        sims = x @ c.T
        runs.append((float((1 - sims.max(axis=1)).sum()), start, c, sims.argmax(axis=1)))
    cost, _, c, labels = min(runs, key=lambda r: r[:2])
    return c, labels, cost


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance; -1 for fewer than two labels, 0 for an item alone in its cluster."""
    names, at = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return -1.0
    member = np.eye(len(names))[at]
    size = member.sum(axis=0)
    total = (1 - x @ x.T) @ member  # distance of every item to every cluster, summed
    own = size[at] - 1
    inside = np.divide(total[np.arange(len(x)), at], own, out=np.zeros(len(x)), where=own > 0)
    other = total / size
    other[np.arange(len(x)), at] = np.inf
    outside = other.min(axis=1)
    top = np.maximum(inside, outside)
    return float(np.where((own > 0) & (top > 0), (outside - inside) / np.where(top > 0, top, 1), 0.0).mean())


def mean_silhouette(items: DataFrame, vec_col: str = "vec", label_col: str = "label") -> DataFrame:
    """One row ``silhouette``: the mean over all items, by distance 1 - inner product, from one vector sum per label.

    An item's distances to a cluster sum to its size less the inner product with the cluster's vector sum, so nothing but
    the sums (a vector a label) reaches the driver. An item alone in its cluster counts 0; null for fewer than two labels.
    """
    flat = items.select(label_col, F.posexplode(vec_col).alias("_i", "_x"))
    per = flat.groupBy(label_col, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    sums = per.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("_n").alias("_n")).collect()
    if len(sums) < 2:
        return items.sparkSession.createDataFrame([(None,)], "silhouette double")
    x = F.col(vec_col)
    totals = F.array(*[F.struct(F.lit(r[label_col]).alias("label"), F.lit(float(r["_n"])).alias("n"), (F.lit(float(r["_n"])) - V.dot(x, V.literal(p["_s"] for p in r["_v"]))).alias("d")) for r in sums])
    each = items.select(F.col(label_col).alias("_l"), (F.lit(1.0) - V.dot(x, x)).alias("_self"), totals.alias("_t"))
    own = F.filter("_t", lambda t: t["label"] == F.col("_l"))[0]
    outside = F.array_min(F.transform(F.filter("_t", lambda t: t["label"] != F.col("_l")), lambda t: t["d"] / t["n"]))
    each = each.select(own["n"].alias("_n"), F.when(own["n"] > 1, (own["d"] - F.col("_self")) / (own["n"] - 1)).alias("_a"), outside.alias("_b"))
    top = F.greatest("_a", "_b")
    return each.agg(F.avg(F.when(F.col("_a").isNull() | (top == 0), 0.0).otherwise((F.col("_b") - F.col("_a")) / top)).alias("silhouette"))


def choose_k(x: np.ndarray, seed: int = 0) -> tuple[int, list[dict]]:
    """The number of clusters of greatest silhouette (rounded to four places; ties to the smaller), and all tried."""
    if len(x) > SEARCH_SAMPLE:
        x = x[np.random.default_rng(seed).choice(len(x), SEARCH_SAMPLE, replace=False)]
    most = min(MOST, len(x) - 1, max(2, int(len(x) ** 0.5)))
    tried = [{"k": k, "silhouette": round(silhouette(x, fit(x, k, seed, restarts=2)[1]), 4)} for k in range(2, most + 1)]
    return (max(tried, key=lambda t: (t["silhouette"], -t["k"]))["k"] if tried else 1), tried


def assign(items: DataFrame, centroids: list[list[float]], item_col: str = "item", vec_col: str = "vec") -> DataFrame:
    """items with ``label`` (nearest centroid, ties to the first) and ``sim``; k centroids stand in the plan."""
    sims = F.array(*[F.struct(V.dot(F.col(vec_col), V.literal(c)).alias("s"), F.lit(-i).alias("c")) for i, c in enumerate(centroids)])
    best = items.withColumn("_b", F.array_max(sims))
    return best.withColumn("label", -F.col("_b.c")).withColumn("sim", F.col("_b.s")).drop("_b")


def describe(assigned: DataFrame, reps: int = 3, max_members: int = 50) -> DataFrame:
    """(cluster, label, size, cohesion, representatives, members, members_truncated); clusters by size, largest first.

    Only the members that are shown are gathered.
    """
    most = max_members if max_members > 0 else 1 << 30
    sums = assigned.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg("sim"), 4).alias("cohesion"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), "item"))
    shown = assigned.select("label", "item", "path", "sim", place.alias("p")).filter(F.col("p") <= max(most, reps))
    lists = shown.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "item", "path", F.round("sim", 4).alias("score")))).alias("_l"))
    number = F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1  # one row a cluster
    out = sums.join(lists, "label").withColumn("cluster", number)
    return out.select("cluster", "label", "size", "cohesion", F.slice("_l", 1, reps).alias("representatives"), F.slice("_l", 1, most).alias("members"), (F.col("size") > most).alias("members_truncated"))


def sample_matrix(items: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most so many items' vectors, by a hash of the item: the same for the same items and seed."""
    vecs = items.orderBy(F.xxhash64("item", F.lit(seed)), "item").limit(most).select("vec").toArrow().column(0).combine_chunks()
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, 0))


def cluster(chunks: DataFrame, level: str = "chunk", k: int | str = "auto", seed: int = 0, sample: int = SAMPLE, max_members: int = 50, reps: int = 3) -> tuple[DataFrame, dict]:
    """Clusters as in ``describe`` and {level, k, items, k_search?}. Clusters without members are left out."""
    items = level_vectors(chunks, level)
    n = items.count()
    if n < 2:
        raise EngineError("at least two items are needed to cluster")
    x = sample_matrix(items, sample, seed)
    info = {"level": level, "items": n}
    if k == "auto":
        k, info["k_search"] = choose_k(x, seed)
    if not 1 <= int(k) <= n:
        raise EngineError(f"k must be from 1 to {n}")
    centroids, _, _ = fit(x, min(int(k), len(x)), seed)
    info["k"] = int(k)
    return describe(assign(items, centroids.tolist()), reps, max_members), info
