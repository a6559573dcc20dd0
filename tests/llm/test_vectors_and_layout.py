import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import op4_topk, op6_packing, op9_shards
from tessella.runtime import Scratch


def plain_topk(rows, k=10):
    ok = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {x for x in ok if x[0] % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(100, 3, 2, 4), (8192, 64, 16, 64)])
def test_topk(spark, monkeypatch, sizes):
    for name, value in zip(("ROWS", "QUERIES", "RUN", "DEPTH"), sizes, strict=True):
        monkeypatch.setattr(op4_topk, name, value)
    r = random.Random(2)
    rows = [(i, [r.randint(-3, 3) / 1024 for _ in range(5)]) for i in range(700)]
    rows += [(100, [0.0] * 5), (801, None), (900, [float("nan")] * 5), (1000, [1.0, None]), (1100, []), (1200, [-0.0005, 0.3]), (1400, [-1e-20, 1e-20, -0.0, 3e-39, -3e-39]), (1500, [-5e-20] * 5), (11, [-1e-20] * 5), (12, [0.0, -0.0] * 2), (1300, [1e12] * 5), (None, [1.0]), (7, [0.002] * 5), (7, [0.002] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = sorted(map(tuple, op4_topk.top_k(df, df.filter("vec_id % 100 = 0")).collect()))
    assert got == plain_topk(rows)
    empty = df.limit(0)
    assert op4_topk.top_k(empty, empty).collect() == []
    copies = spark.createDataFrame([(i % 3 * 50, [1.0, 2.0]) for i in range(90)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, op4_topk.top_k(copies, copies.filter("vec_id % 100 = 0")).collect()))
    assert got == plain_topk([(i % 3 * 50, [1.0, 2.0]) for i in range(90)])
    few = df.filter("vec_id in (200, 201)")
    assert op4_topk.top_k(few, few.filter("vec_id = 200")).count() == 1


def test_search_stops_early():
    """On lists with a clear winner the algorithm reads a small part of them."""
    r = np.random.default_rng(0)
    m = np.floor(r.normal(size=(4000, 3)) * 10)
    m[:20] += 500
    lists = op4_topk.Lists(np.arange(4000), m, np.argsort(m, axis=0, kind="stable"))
    read, order = [], lists.order

    class Watched:
        def __getitem__(self, at):
            read.append(at[0].size)
            return order[at]

    lists.order = Watched()
    best = lists.search(-1, np.array([1.0, 2.0, 1.0]), 10, [])
    want = sorted((-int(s), i) for i, s in enumerate(m @ np.array([1.0, 2.0, 1.0])))[:10]
    assert best == want and sum(read) < 4000


def plain_packing(counts, lengths):
    """Bins (size, pieces), pieces placed one by one, longest first."""
    def cost(x):
        return 192 + x + x * x / 16384

    def filled(size, piece):
        room, put = size, 0
        for x in sorted((x for x in counts if x <= piece), reverse=True):
            while room >= x:
                room, put = room - x, put + x
        return put

    bins = []
    for piece in sorted(counts, reverse=True):
        for _ in range(counts[piece]):
            fits = [(size - sum(inside), size, i) for i, (size, inside) in enumerate(bins) if size - sum(inside) >= piece]
            if fits:
                bins[min(fits)[2]][1].append(piece)
            else:
                bins.append((min((s for s in lengths if s >= piece), key=lambda s: (cost(s) / filled(s, piece), s)), [piece]))
    return sorted((min(s for s in lengths if s >= sum(inside)), sorted(inside)) for _, inside in bins), sum(s > min(x for x in lengths if x >= sum(i)) for s, i in bins)


def placed_bins(counts, plan):
    """Bins (size, pieces) of a plan, pieces side by side."""
    bins, caps, rank = collections.defaultdict(list), {}, 0
    for size in sorted(counts):
        for _ in range(counts[size]):
            i = plan.rank.searchsorted(rank, "right") - 1
            j = rank - plan.rank[i]
            b = plan.base[i] + j // plan.each[i]
            bins[b].append((plan.at[i] + j % plan.each[i] * size, size))
            caps[b] = plan.size[plan.first_bin.searchsorted(b, "right") - 1]
            rank += 1
    for pieces in bins.values():
        ends = list(itertools.accumulate(size for _, size in sorted(pieces)))
        assert [at for at, _ in sorted(pieces)] == [0, *ends[:-1]]
    return sorted((int(caps[b]), sorted(size for _, size in pieces)) for b, pieces in bins.items())


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    """The whole plan, bin for bin, against placing pieces one by one."""
    r = random.Random(seed)
    lengths = r.choice([(8, 16, 32), (512, 1024, 2048, 4096), (10,), (7, 13)])
    known = [r.randint(1, max(lengths)) for _ in range(r.choice([3, 1000]))]
    counts = collections.Counter(r.choice(known) for _ in range(r.choice([1, 5, 60, 300])))
    assert placed_bins(counts, op6_packing.make_plan(dict(counts), lengths)) == plain_packing(counts, lengths)[0]


def test_sizes_are_chosen_together():
    """Larger bins than the smallest that fits are opened where that costs less, and downsized where they stay empty."""
    counts = {600: 31, 300: 7}
    want, downsized = plain_packing(counts, op6_packing.LENGTHS)
    got = placed_bins(counts, op6_packing.make_plan(counts))
    assert got == want and downsized and {s for s, _ in got} >= {2048}
    spent = sum(op6_packing.cost(s) for s, _ in got)
    for single in op6_packing.LENGTHS[1:]:
        assert spent < sum(op6_packing.cost(s) for s, _ in placed_bins(counts, op6_packing.make_plan(counts, (single,))))


def test_packing(spark, table, docs, odd):
    rows = [*docs[:80], *odd, (5, "a b c"), (None, "w " * 10_000)]
    got = op6_packing.pack(op6_packing.token_counts(table(rows))).collect()
    import brute

    words = collections.Counter()
    for d, t in rows:
        words[d] += len(brute.WORD.findall(t or ""))
    placed = collections.Counter()
    bins = collections.defaultdict(list)
    for r in got:
        placed[r["doc_id"]] += r["length"]
        if r["length"]:
            bins[r["bin_id"]].append((r["bin_offset"], r["length"], r["capacity"]))
        else:
            assert r["bin_id"] is None
    assert placed == words
    for pieces in bins.values():
        end = 0
        for at, size, cap in sorted(pieces):
            assert at == end and cap in op6_packing.LENGTHS
            end += size
        assert end <= cap
    assert {(r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] is None} == {(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)}
    assert op6_packing.pack(op6_packing.token_counts(table([]))).collect() == []
    all_ = op6_packing.totals(op6_packing.pack(op6_packing.token_counts(table(rows)))).first()
    caps = {r["bin_id"]: r["capacity"] for r in got if r["length"]}
    assert (all_["bins"], all_["tokens"], all_["capacity"]) == (len(caps), sum(words.values()), sum(caps.values()))
    assert all_["cost"] == pytest.approx(sum(op6_packing.cost(c) for c in caps.values())) and all_["fill"] == pytest.approx(sum(words.values()) / sum(caps.values()))
    own = table(rows).selectExpr("doc_id rank", "n_chars _n", "text")
    assert op6_packing.pack(op6_packing.token_counts(own, "rank"), id_col="rank").count() == len(got)


@pytest.mark.parametrize(("bits", "dims"), [(2, 2), (4, 2), (3, 3), (4, 3), (2, 4)])
def test_hilbert_curve(bits, dims):
    """Every cell once, and neighbours on the curve are neighbours in the cube."""
    table = op9_shards.hilbert_table(bits, dims)
    cells = sorted(range(len(table)), key=table.__getitem__)
    assert sorted(table) == list(range(len(table)))
    at = lambda c: [c >> (bits * (dims - 1 - d)) & ((1 << bits) - 1) for d in range(dims)]
    assert all(sum(abs(a - b) for a, b in zip(at(x), at(y), strict=True)) == 1 for x, y in zip(cells, cells[1:], strict=False))


def test_shards(spark, table, docs, odd, tmp_path):
    rows = [*docs, *odd, (5, "a b c"), (5, "a b c"), (None, None)]
    df = table(rows)
    got = op9_shards.hilbert_shards(df, ("lang", "source", "n_chars"), 7).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    few = op9_shards.hilbert_shards(table(rows[:3]), ("lang", "n_chars"), 40).collect()
    assert [r["slot"] for r in few] == [0, 0, 0] and len({r["shard"] for r in few}) == 3
    assert op9_shards.hilbert_shards(table([]), ("lang",), 40).collect() == []


def test_written_shards(spark, table, odd, tmp_path):
    """Every row, null and repeated ids and clashing names too, in the folder of its shard."""
    rows = [*odd, (5, "a b c"), (5, "a b c"), (5, "other"), (None, None), (None, "x")]
    df = table(rows)
    name = op9_shards.write_shards(df, ("lang", "source", "n_chars"), 4, f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert name == "_shard" and sorted(got.columns) == sorted([*df.columns, "_shard"])
    assert sorted(map(str, got.drop("_shard").select(df.columns).collect())) == sorted(map(str, df.collect()))
    sizes = [r["count"] for r in got.groupBy("_shard").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_shards_can_be_skipped(spark):
    """A shard covers few values of every dimension, also of those with few values; cells follow plain ranks."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").drop("text").withColumn("text", F.lit(""))
    dims = ("lang", "source", "n_chars")
    placed = op9_shards.hilbert_shards(docs, dims, 40)
    boxes = op9_shards.shard_bounds(docs, placed, dims).collect()
    assert len(boxes) == 40 and sum(b["rows"] for b in boxes) == docs.count()
    for d, most in zip(dims, (0.6, 0.6, 0.6), strict=True):
        asked = [r[0] for r in docs.select(d).distinct().orderBy(F.xxhash64(d)).limit(40).collect()]
        read = [sum(b[f"min_{d}"] <= v <= b[f"max_{d}"] for b in boxes) / 40 for v in asked]
        assert sum(read) / len(read) <= most, (d, sum(read) / len(read))
    values = [r[0] for r in docs.select("source").collect()]
    order = sorted(values)
    bounds = op9_shards._string_cells(docs, "source", 16, Scratch(spark))
    for v in set(values):
        assert max((c for x, c in bounds if x <= v)) == order.index(v) * 16 // len(order)
