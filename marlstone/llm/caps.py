"""Problem 4: at most so many records of a contributor, the better ones.

A histogram of quality bins per contributor is summed up before and after one
shuffle of counts. It names the bin in which the cap is reached; rows of better
bins stay and rows of worse bins go without being ranked. Only rows of that
borderline bin are ordered, and only as far as the open places: the first
``cap`` of each partition travel (Spark's window group limit), so the largest
contributor sends at most ``cap`` rows from a partition; where more than
``RANK_ROWS`` places are open, ranges of the order are counted instead. The last row to stay
then is a threshold, and the rest of the bin is compared with it in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.runtime import BROADCAST_ROWS, join_lookup, staged

#: Open places up to which a contributor's border rows are ranked in one task; beyond, they are ranked in ranges.
RANK_ROWS = 10_000


def cap_contributors(
    rows: DataFrame,
    contributor: list[Column],
    quality: Column,
    tie: Column,
    cap: int | None = None,
    share: float | None = None,
    bin_of: Column | None = None,
    bound: int = BROADCAST_ROWS,
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """``rows`` with boolean column ``kept``: of each contributor the first rows by ``quality``
    descending (null last), then ``tie`` ascending (null last), up to ``cap`` rows or
    ``floor(share * all rows)``, the smaller where both are given.

    Rows with a null in ``contributor`` belong to none and stay. Rows that tie
    in both are alike to the order; of these, as many stay as there are places,
    by a hash of the row, and exact repeats of one row are told apart by
    nothing but their position. ``bin_of`` must not order against ``quality``;
    by default each distinct quality is a bin of its own up to 1/1000.
    """
    if (cap is None and share is None) or (cap is not None and cap < 0):
        raise ValueError("cap or share")
    cols = rows.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    q = quality.cast("double")
    bins = (bin_of if bin_of is not None else F.floor(q * 1000)).cast("double")
    base = rows.select(
        row.alias("_row"),
        F.when(~_any_null(contributor), F.to_json(F.array(*[c.cast("string") for c in contributor]))).alias("_who"),
        F.coalesce(bins, F.lit(float("-inf"))).alias("_bin"),
        F.struct(F.coalesce(-q, F.lit(float("inf"))).alias("q"), tie.isNull().alias("n"), tie.alias("t"), F.xxhash64(F.to_json(row)).alias("h")).alias("_order"),
    )
    counts = base.where(F.col("_who").isNotNull()).groupBy("_who", "_bin").agg(F.count("*").alias("n"))
    most = F.lit(cap).cast("long") if cap is not None else F.lit(1 << 62)
    if share is not None:
        most = F.least(most, F.lit(int(share * rows.count())).cast("long"))
    w = Window.partitionBy("_who").orderBy(F.col("_bin").desc())
    run = counts.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_most", most)
    cut = staged(
        run.where((F.col("upto") > F.col("_most")) & (F.col("upto") - F.col("n") <= F.col("_most"))).select(
            "_who", F.col("_bin").alias("_cut"), (F.col("_most") - (F.col("upto") - F.col("n"))).alias("_open")
        ),
        "cuts",
    )
    marked = join_lookup(base, cut, ["_who"], "left", bound=bound)
    border = marked.where((F.col("_bin") == F.col("_cut")) & (F.col("_open") > 0)).select("_who", "_order", "_open")
    widest = cut.agg(F.max("_open")).first()[0] or 0
    thresholds = _by_rank(border, int(widest)) if widest <= rank_rows else _by_range(border)
    thresholds = staged(thresholds, "thresholds")
    told = join_lookup(marked, thresholds, ["_who"], "left", bound=bound)
    at = told.withColumn("_at", (F.col("_bin") == F.col("_cut")) & (F.col("_order") == F.col("_last")))
    kept = (
        F.when(F.col("_cut").isNull(), True)
        .when(F.col("_bin") > F.col("_cut"), True)
        .when(F.col("_bin") < F.col("_cut"), False)
        .otherwise(F.coalesce(F.col("_order") < F.col("_last"), F.lit(False)))
    )
    other = at.where(~F.coalesce("_at", F.lit(False))).select("_row", kept.alias("kept"))
    out = other.unionByName(_first_repeats(at.where("_at").select("_row", "_who", "_equal")))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in cols if c != "kept"], "kept")


def _by_rank(border: DataFrame, widest: int) -> DataFrame:
    """_who, _last, _equal: the last order to stay and how many of its rows; at most ``widest`` rows of a contributor leave a partition."""
    rank = F.row_number().over(Window.partitionBy("_who").orderBy("_order"))
    ranked = border.withColumn("_rn", rank).where(F.col("_rn") <= widest).where(F.col("_rn") <= F.col("_open"))
    return ranked.groupBy("_who", "_order").agg(F.count("*").alias("_equal")).groupBy("_who").agg(F.max(F.struct(F.col("_order").alias("o"), F.col("_equal").alias("e"))).alias("m")).select("_who", F.col("m.o").alias("_last"), F.col("m.e").alias("_equal"))


def _by_range(border: DataFrame) -> DataFrame:
    """The same where many places are open: equal rows are counted, and the counts summed over ranges of (contributor, order), so no contributor is one task."""
    counts = border.groupBy("_who", "_order").agg(F.count("*").alias("n"), F.first("_open").alias("_open"))
    ranged = staged(counts.repartitionByRange("_who", "_order").withColumn("_part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("_who").orderBy("_part")
    before = ranged.groupBy("_who", "_part").agg(F.sum("n").alias("n")).select("_who", "_part", (F.sum("n").over(w) - F.col("n")).alias("_before"), F.sum("n").over(w).alias("_after"))
    reached = ranged.join(before, ["_who", "_part"]).where((F.col("_before") < F.col("_open")) & (F.col("_open") <= F.col("_after")))
    run = F.col("_before") + F.sum("n").over(Window.partitionBy("_who", "_part").orderBy("_order")) - F.col("n")
    last = reached.withColumn("_run", run).where((F.col("_run") < F.col("_open")) & (F.col("_open") <= F.col("_run") + F.col("n")))
    return last.select("_who", F.col("_order").alias("_last"), (F.col("_open") - F.col("_run")).alias("_equal"))


def _first_repeats(rows: DataFrame) -> DataFrame:
    """_row, kept: of each contributor's rows, which are alike, ``_equal`` stay. Places are given out to the written parts by their counts, so repeats are never gathered."""
    tied = staged(rows.withColumn("_part", F.spark_partition_id()), "tied")
    counts = tied.groupBy("_who", "_part").agg(F.count("*").alias("n"))
    before = counts.select("_who", "_part", (F.sum("n").over(Window.partitionBy("_who").orderBy("_part")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_who", "_part").orderBy(F.lit(1)))
    return tied.join(before, ["_who", "_part"]).select("_row", (place <= F.col("_equal")).alias("kept"))


def _any_null(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c.isNull()
    return out
