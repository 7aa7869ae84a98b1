"""Ranks and running counts within groups of any size: ranges of the order are counted, so no group is one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.runtime import staged


def _in_ranges(rows: DataFrame, group: list[str], order: list[str], n: str) -> DataFrame:
    """``rows``, written by ranges of (group, order), with _part, and _before: the sum of ``n`` in earlier ranges of the group."""
    ranged = staged(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "_part").agg(F.sum(n).alias("_n"))
    w = Window.partitionBy(*group)
    offsets = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))
    same = reduce(lambda x, y: x & y, [ranged[g].eqNullSafe(offsets[f"_g_{g}"]) for g in group], ranged["_part"] == offsets["_p"])
    return ranged.join(offsets, same).drop("_p", *[f"_g_{g}" for g in group])


def running_counts(counts: DataFrame, group: list[str], value: str, n: str) -> DataFrame:
    """``counts`` (one row a group and value) with upto, the sum of ``n`` up to and with the value, and total. Null groups are a group."""
    rows = _in_ranges(counts, group, [value], n)
    upto = F.col("_before") + F.sum(n).over(Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).withColumnRenamed("_total", "total").drop("_part", "_before")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their number within the group, from 1, by a total order."""
    out = _in_ranges(rows.withColumn("_one", F.lit(1).cast("long")), group, order, "_one")
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return out.withColumn(name, number).drop("_one", "_part", "_before", "_total")
