"""A table of decisions that are taken once and kept for a while: looked up by a digest of all inputs, aged, and bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import join_lookup

#: How long a decision holds, in seconds, and how many are kept.
HOLDS, KEPT = 6 * 3600, 20_000


def digest_of(columns: list[str]) -> Column:
    """One key for all inputs of a decision; null and the empty text differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def looked_up(requests: DataFrame, decisions: DataFrame, columns: list[str], now: Column, holds: int = HOLDS) -> DataFrame:
    """``requests`` with decision and known: the newest decision on the same inputs that isn't older than ``holds`` seconds at ``now``.

    ``decisions`` has key, decision, decided. Unknown decisions are never kept, so a null one counts as none.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("decided").cast("timestamp"))
    fresh = decisions.where(F.col("decision").isNotNull() & (age >= 0) & (age <= F.lit(holds * 1_000_000)))
    newest = fresh.groupBy("key").agg(F.max_by("decision", "decided").alias("decision"))
    out = join_lookup(requests.withColumn("key", digest_of(columns)), newest, ["key"], "left")
    return out.withColumn("known", F.col("decision").isNotNull())


def remembered(decisions: DataFrame, taken: DataFrame, kept: int = KEPT) -> DataFrame:
    """key, decision, decided: old and new decisions, of a key the newest, of all the ``kept`` newest; unknown ones aren't kept."""
    every = decisions.select("key", "decision", "decided").unionByName(taken.select("key", "decision", "decided")).where(F.col("decision").isNotNull())
    newest = every.groupBy("key").agg(F.max_by("decision", "decided").alias("decision"), F.max("decided").alias("decided"))
    return newest.orderBy(F.col("decided").desc(), "key").limit(kept)


def graded(head: Column, most: int = 3) -> Column:
    """A graded answer from 0 to ``most`` as a score from 0 to 1; anything else is no answer."""
    return F.when((head >= 0) & (head <= most), head.cast("double") / most)


def is_fresh(published: Column, now: Column, longest: float) -> Column:
    """Whether something published is at most ``longest`` seconds old; what lies in the future isn't."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 1e6
    return (age >= 0) & (age <= longest)
