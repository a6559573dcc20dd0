"""Vector arithmetic as Spark expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vec: Column | str) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, accumulated in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """v scaled to length 1; the zero vector stays as it is."""
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x.cast("double"))))[0]


def literal(vec) -> Column:
    """A vector on the driver as one literal."""
    return F.lit([float(x) for x in vec])


def group_vectors(df: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """(by, vec, items): the normalised mean vector of each group, by one aggregation over (group, dimension)."""
    flat = df.select(by, F.posexplode(vec).alias("_i", "_x"))
    mean = flat.groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    gathered = mean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.max("_n").alias("items"))
    return gathered.select(by, normalised(F.transform("_v", lambda x: x["_m"])).alias("vec"), "items")
