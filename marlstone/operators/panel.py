"""Features of entities over calendar steps, in one shuffle by entity.

A panel has a row an (entity, idx), idx being the step's position in the calendar.
Offsets are calendar offsets: a RANGE frame of exactly ``-k`` finds the row k steps
earlier or nothing, so gaps need neither densifying nor a self-join. All windows
share one partitioning, hence one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.runtime import js_round


def calendar(steps: DataFrame, date: str) -> DataFrame:
    """date, idx (from 0), prev_date of the distinct dates; a calendar is small, so it is ordered in one task."""
    w = Window.orderBy("date")
    return steps.select(F.col(date).alias("date")).where(F.col("date").isNotNull()).distinct().select("date", (F.row_number().over(w) - 1).cast("int").alias("idx"), F.lag("date").over(w).alias("prev_date"))


def at_offset(value: str, back: int, entity: str = "entity", idx: str = "idx") -> Column:
    """``value`` exactly ``back`` calendar steps earlier; null if that step has no row."""
    return F.first(value).over(Window.partitionBy(entity).orderBy(idx).rangeBetween(-back, -back))


def pct_return(now: Column, base: Column) -> Column:
    """Percent change to 4 digits; null unless ``now`` is positive and ``base`` neither null nor 0."""
    return F.when((now > 0) & (base != 0), js_round((now / F.nullif(base, F.lit(0.0)) - 1) * 100, 4))


def streak(state: Column, entity: str = "entity", idx: str = "idx") -> Column:
    """Length of the run of true ``state`` up to this row over consecutive steps: null where the
    state is null, 0 where false; a missing row, false or null before ends the run."""
    w = Window.partitionBy(entity).orderBy(idx)
    before = F.max(state.cast("int")).over(w.rangeBetween(-1, -1))
    begins = F.when(state & ~F.coalesce(before == 1, F.lit(False)), F.col(idx))
    return F.when(state, F.col(idx) - F.max(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).when(state.isNotNull(), F.lit(0)).cast("int")


def with_traded_means(panel: DataFrame, size: int = 20) -> DataFrame:
    """Adds avg_volume, avg_amount: means over the ``size`` rows with positive volume before this
    one, skipping others, null if there are fewer; and volume_ratio, this volume over the unrounded
    mean, null unless the volume is positive.

    Rows are ordered by how many traded rows precede them; the frame of the last
    ``size`` counts then holds exactly those rows, and untraded ones add nothing.
    """
    traded = F.col("volume") > 0
    w = Window.partitionBy("entity").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ranked = panel.withColumn("_before", F.coalesce(F.sum(traded.cast("int")).over(w), F.lit(0)).cast("int"))
    last = Window.partitionBy("entity").orderBy("_before").rangeBetween(-size, -1)
    summed = (
        ranked.withColumn("_n", F.sum(traded.cast("int")).over(last))
        .withColumn("_v", F.sum(F.when(traded, F.col("volume").cast("decimal(28,4)"))).over(last).cast("double"))
        .withColumn("_a", F.sum(F.when(traded, F.col("amount").cast("decimal(28,4)"))).over(last).cast("double"))
    )
    full = F.col("_n") == size
    return summed.select(
        *panel.columns,
        F.when(full, js_round(F.col("_v") / size, 2)).alias("avg_volume"),
        F.when(full, js_round(F.col("_a") / size, 2)).alias("avg_amount"),
        F.when(full & traded, js_round(F.col("volume") / (F.col("_v") / size), 4)).alias("volume_ratio"),
    )


def listing_index(listed: Column, start: Column, entity: str = "entity", idx: str = "idx") -> Column:
    """1-based count of the entity's rows on and after its listing step; null if it was listed before
    the window, or the row precedes the listing. An unlisted entity first seen after the start counts from there."""
    w = Window.partitionBy(entity)
    upto = w.orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    since = F.count_if(F.col(idx) >= listed).over(upto)
    seen = F.count("*").over(upto)
    first = F.min(idx).over(w)
    return F.when(listed < start, F.lit(None)).when(listed.isNotNull(), F.when(F.col(idx) >= listed, since)).when(first > start, seen).cast("int")


def derive_state(panel: DataFrame) -> DataFrame:
    """The state of every (entity, idx): panel columns entity, idx, date, close, prev_close, volume, amount, and

    pct_change on the row's own prev_close; return_5, return_20 by calendar offset;
    is_up (closed above prev_close; null if that is unknown) and up_streak;
    first_idx; avg_volume, avg_amount, volume_ratio over the 20 traded rows before.
    Null or non-positive prices give null, never 0; an empty panel gives no rows.
    """
    up = F.when((F.col("prev_close") > 0) & F.col("close").isNotNull(), (F.col("close") > F.col("prev_close")) & (F.col("volume") > 0))
    base = panel.withColumn("is_up", up)
    out = base.select(
        *panel.columns,
        "is_up",
        F.when(F.col("close") > 0, pct_return(F.col("close"), F.when(F.col("prev_close") > 0, F.col("prev_close")))).alias("pct_change"),
        pct_return(F.col("close"), at_offset("close", 5)).alias("return_5"),
        pct_return(F.col("close"), at_offset("close", 20)).alias("return_20"),
        streak(F.col("is_up")).alias("up_streak"),
        F.min("idx").over(Window.partitionBy("entity")).alias("first_idx"),
    )
    return with_traded_means(out)
