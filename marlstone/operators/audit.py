"""Checks of incoming data: first-match classification, agreement of two sources, valid bars, latest periods, merges, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import rate
from marlstone.runtime import join_lookup


def classified(rows: DataFrame, rules: list[tuple[str, Column]], other: str = "VALID", name: str = "status") -> DataFrame:
    """Adds the name of the first rule a row meets, in their order; an unknown condition is not met."""
    status = F.lit(other)
    for label, condition in reversed(rules):
        status = F.when(F.coalesce(condition, F.lit(False)), label).otherwise(status)
    return rows.withColumn(name, status)


def publishable(counted: DataFrame, good: list[str], least: float = 0.98) -> DataFrame:
    """One row: rows, the share with a good status, and whether that suffices; counted has status and n."""
    out = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("status").isin(good), F.col("n"))), F.lit(0)).alias("good"))
    return out.select("rows", rate(F.col("good"), F.col("rows"), 5).alias("coverage"), F.coalesce(F.col("good") >= F.col("rows") * least, F.lit(False)).alias("publishable"))


def coherence(a: DataFrame, b: DataFrame, key: str, tolerance: dict[str, float]) -> DataFrame:
    """field, compared, matched, rate: by field the rows of both sources and those whose values differ by no more than the tolerance."""
    x = a.select(F.col(key).alias("_k"), *[F.col(f).cast("double").alias(f"a_{f}") for f in tolerance])
    y = b.select(F.col(key).alias("_k"), *[F.col(f).cast("double").alias(f"b_{f}") for f in tolerance])
    known = {f: F.col(f"a_{f}").isNotNull() & F.col(f"b_{f}").isNotNull() for f in tolerance}
    near = {f: F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= t for f, t in tolerance.items()}
    sums = x.join(y, "_k").agg(*[F.count_if(known[f]).alias(f"n_{f}") for f in tolerance], *[F.count_if(known[f] & near[f]).alias(f"m_{f}") for f in tolerance])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("compared"), F.col(f"m_{f}").alias("matched")) for f in tolerance]))
    return sums.select(rows.alias("r")).select("r.*").withColumn("rate", rate(F.col("matched"), F.col("compared"), 5))


def broken_bars(bars: DataFrame, entity: str, at: str) -> DataFrame:
    """The bars (open, high, low, close, volume) that can't be: a time not after the one before, a low above or a high
    below open or close, negative volume, or a value that is null or not finite."""
    values = ["open", "high", "low", "close", "volume"]
    odd = F.exists(F.array(*[F.col(c).cast("double") for c in values]), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    repeated = F.count("*").over(Window.partitionBy(entity, at)) > 1
    wrong = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close")) | (F.col("volume") < 0)
    return bars.withColumn("_bad", odd | F.coalesce(wrong, F.lit(False)) | F.col(at).isNull() | repeated).where("_bad").drop("_bad")


def latest_period(rows: DataFrame, entity: str, period: str, order: list[Column] | None = None, most: int | None = None) -> DataFrame:
    """Rows of each entity's latest known period, and of those the first ``most`` by ``order``."""
    latest = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max(period).alias("_last"))
    last = join_lookup(rows, latest, [entity]).where(F.col(period) == F.col("_last")).select(*rows.columns)
    if most is None:
        return last
    return last.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def merged(rows: DataFrame, keys: list[str], lists: list[str], best: dict[str, str]) -> DataFrame:
    """One row a key: the distinct members of list columns, sorted, and the value of each ``best`` column by the largest of another."""
    return rows.groupBy(*keys).agg(
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists],
        *[F.max_by(c, by).alias(c) for c, by in best.items()],
    )


def overlaid(base: DataFrame, over: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with each field taken from ``over`` where that has a value; an ``over`` key that ``base`` lacks fails the query."""
    marks = over.select(F.col(key), *[F.col(f).alias(f"_over_{f}") for f in fields], F.lit(True).alias("_is"))
    both = base.withColumn("_here", F.lit(True)).join(marks, key, "full_outer")
    checked = both.withColumn(key, F.when(F.col("_here").isNotNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no base row for "), F.col(key).cast("string"))).cast(dict(base.dtypes)[key])))
    return checked.select(*[F.coalesce(f"_over_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])
