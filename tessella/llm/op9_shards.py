"""Sharding along a Hilbert curve: metadata are quantised, rows sorted by curve index, and runs of the order cut.

Rows that are near each other in every dimension get near indices, so each shard covers a small box of each dimension
and a reader can skip shards by any of them (``shard_bounds`` has the boxes). A value's cell is its rank's share of all
rows, so each dimension fills its whole axis, however few values it has: four equal languages stand a quarter of the axis
apart. The law is ``rows``: shard sizes differ by one row at most. Ties of the index are broken by id and then by the
text's checksum, so one hot cell spreads over as many shards as it fills.

Edge cases: null text counts as empty; null metadata take the lowest cell; equal rows are separate rows; with fewer
rows than shards the last shards stay empty; an empty table gives no rows; other columns of the input are not read,
whatever their names (``write_shards`` writes them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.ranks import ranked
from tessella.llm.texts import fresh
from tessella.runtime import Scratch

#: Bits a dimension; the curve's table then has 2 ** (BITS * dimensions) cells.
BITS = 4


def hilbert_table(bits: int, dims: int) -> list[int]:
    """Curve index of every cell, cells numbered by their coordinates as digits of base 2 ** bits.

    Built by walking the cube's corners in Gray-code order and recursing with the corner's rotation and reflection.
    """
    side = 1 << bits
    table = [0] * side**dims
    for cell in range(len(table)):
        x = [cell >> (bits * (dims - 1 - d)) & (side - 1) for d in range(dims)]
        entry, turn, index = 0, 0, 0
        for level in range(bits - 1, -1, -1):
            corner = sum(((x[d] >> level) & 1) << d for d in range(dims))
            corner = _rotate(corner ^ entry, turn + 1, dims)
            w = _gray_rank(corner)
            index = index << dims | w
            entry ^= _rotate(_entry(w), -turn - 1, dims)
            turn = (turn + _direction(w, dims) + 1) % dims
        table[cell] = index
    return table


def _rotate(v: int, by: int, dims: int) -> int:
    by %= dims
    return (v >> by | v << (dims - by)) & ((1 << dims) - 1)


def _gray_rank(g: int) -> int:
    out = 0
    while g:
        out ^= g
        g >>= 1
    return out


def _entry(w: int) -> int:
    e = 2 * ((w - 1) // 2)
    return e ^ e >> 1 if w else 0


def _trailing_ones(w: int) -> int:
    return (~w & w + 1).bit_length() - 1


def _direction(w: int, dims: int) -> int:
    return 0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % dims


def _value(col: str, kind: str) -> Column:
    """A metadata column as a string or a double, without nulls."""
    if kind == "string":
        return F.coalesce(F.col(f"`{col}`"), F.lit(""))
    return F.coalesce(F.col(f"`{col}`").cast("double"), F.lit(float("-inf")))


def _string_cells(df: DataFrame, name: str, cells: int, scratch: Scratch) -> list[tuple[str, int]]:
    """(least value, cell) of each cell that has one, by the exact rank of every value; at most ``cells`` of them.

    Values are counted, and the counts added up along range partitions, so that many values are no one's burden.
    """
    counts = scratch.keep(df.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n")))
    kept = scratch.keep(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    base, total = {}, 0
    for r in kept.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():  # one row a partition
        base[r["p"]], total = total, total + r["n"]
    if not total:
        return []
    before = F.element_at(F.lit([base.get(i, 0) for i in range(max(base) + 1)]), F.col("p") + 1) + F.sum("n").over(Window.partitionBy("p").orderBy("v")) - F.col("n")
    got = kept.select("v", F.floor(before * cells / total).alias("cell")).groupBy("cell").agg(F.min("v").alias("v")).orderBy("v").collect()
    scratch.drop(counts, kept)
    return [(r["v"], r["cell"]) for r in got]


def _cells(df: DataFrame, names: list[str], bits: int, scratch: Scratch) -> list[Column]:
    """Each value's cell, 0 to 2 ** bits - 1, as expressions with bounds over all rows in them."""
    cells, kinds, out = 1 << bits, dict(df.dtypes), []
    numbers = [c for c in names if kinds[c] == "double"]
    shares = [i / cells for i in range(1, cells)]
    cuts = df.agg(F.lit(0), *[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers]).first()
    for c in names:
        cell = F.lit(0)
        if kinds[c] == "double":
            for x in cuts[c] or []:
                cell += F.when(F.col(c) > x, 1).otherwise(0)
        else:
            for x, at in _string_cells(df, c, cells, scratch):
                cell = F.when(F.col(c) >= x, at).otherwise(cell)
        out.append(cell.cast("int"))
    return out


def _curve(slim: DataFrame, names: list[str], bits: int, scratch: Scratch) -> Column:
    cell = F.lit(0)
    for q in _cells(slim, names, bits, scratch):
        cell = cell * (1 << bits) + q
    return F.element_at(F.lit(hilbert_table(bits, len(names))), cell.cast("int") + 1).cast("int")


def _shard_of(n: int, shards: int, rank: str = "rank") -> Column:
    return F.expr(f"cast({rank} * {shards} div {max(n, 1)} as int)")


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...], shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id, size, text_crc32, curve index, shard and slot of every row."""
    scratch, text, kinds = Scratch(docs.sparkSession), F.coalesce(F.col(text_col), F.lit("")), dict(docs.dtypes)
    names = [f"d{i}" for i in range(len(dims))]
    size = (F.octet_length(text).cast("long") + 16).alias("size")
    slim = scratch.keep(docs.select(F.col(id_col).alias("id"), size, F.crc32(text.cast("binary")).alias("text_crc32"), *[_value(d, kinds[d]).alias(n) for d, n in zip(dims, names, strict=True)]))
    curve = _curve(slim, names, bits, scratch)
    placed, n = ranked(slim.select("id", "size", "text_crc32", curve.alias("curve")), ["curve", "id", "text_crc32"], "rank", scratch, read=True)
    first = F.expr(f"cast((cast(shard as bigint) * {n} + {shards - 1}) div {shards} as bigint)")  # the shard's lowest rank
    return placed.withColumn("shard", _shard_of(n, shards)).withColumn("slot", F.col("rank") - first).withColumnRenamed("id", id_col)


def write_shards(docs: DataFrame, dims: tuple[str, ...], shards: int, path: str, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> str:
    """All rows and columns of docs as Parquet, a folder per shard, in the order of ``hilbert_shards``; returns the name of
    the folders' column (``shard``, or one that clashes with none of docs').

    The rows themselves are ranked, so that ids may be null or repeat. Python is not involved.
    """
    scratch, kinds = Scratch(docs.sparkSession), dict(docs.dtypes)
    curve, crc, rank, shard, *names = fresh(docs.columns, "curve", "crc", "rank", "shard", *[f"d{i}" for i in range(len(dims))])
    valued = docs.select("*", *[_value(d, kinds[d]).alias(n) for d, n in zip(dims, names, strict=True)])
    index = _curve(valued.select(*names), names, bits, scratch)
    rows = valued.select("*", index.alias(curve), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias(crc)).drop(*names)
    placed, n = ranked(rows, [curve, id_col, crc], rank, scratch, read=True)
    placed.withColumn(shard, _shard_of(n, shards, f"`{rank}`")).drop(curve, crc, rank).write.partitionBy(shard).parquet(path)
    scratch.drop(placed)
    return shard


def shard_bounds(docs: DataFrame, placed: DataFrame, dims: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """(shard, rows, least and greatest value of each dimension): what a reader skips shards by. Ids must be unique."""
    both = docs.select(F.col(id_col), *dims).join(placed.select(F.col(id_col), F.col("shard").alias("_shard")), id_col)
    return both.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("rows"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])


def op9_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by rows, ordered by language, source and length."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = hilbert_shards(docs, ("lang", "source", "n_chars"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
