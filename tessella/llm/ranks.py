"""Dense ranks of a whole table in a given order, without one task or one key holding it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.texts import fresh
from tessella.runtime import Scratch


def ranked(df: DataFrame, order: list[str], name: str = "rank", keep: Scratch | None = None, read: bool = False) -> tuple[DataFrame, int]:
    """df with ``name``: 0 to n - 1 in the order of the columns ``order`` (ties in any order), and n.

    Rows are range-partitioned on all of ``order``, so that a hot value of the first column is split by the next ones;
    the sorted partitions are written to the shared folder, which fixes their numbers, and each gets the sum of the
    partitions before it. What reaches the driver is one number per partition. Range partitions are planned from a pass
    over the rows, so these are written first, unless ``read`` says that they come straight from a file.
    """
    keep = keep or Scratch(df.sparkSession)
    rows = df if read else keep.keep(df)
    part, row = fresh([*df.columns, name], "part", "row")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = keep.keep(ordered.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(row)))
    if not read:
        keep.drop(rows)
    counts = {r[part]: r["n"] for r in numbered.groupBy(part).agg(F.count("*").alias("n")).collect()}
    base, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        base.append(total)
        total += counts.get(i, 0)
    start = F.element_at(F.lit(base), F.col(part) + 1) if base else F.lit(0)
    return numbered.withColumn(name, (start + F.col(row)).cast("long")).drop(part, row), total
