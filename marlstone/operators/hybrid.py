"""Combining a set of scored candidates with a ranked state, in the orders that decide who owns the rank."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.plans.spec import Condition, ordering, passing


def finite(column: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    c = column.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def semantic_first(hits: DataFrame, state: DataFrame, filters: tuple[Condition, ...], sort: tuple[str, bool], limit: int = 20) -> DataFrame:
    """Candidates (entity, score) joined with the filtered state, sorted by a state field.

    With filters a candidate that isn't in the filtered state is dropped;
    without, it stays with an unknown metric and sorts last. Ties go to the
    higher score, then the entity.
    """
    rows = passing(state, filters)
    joined = hits.join(rows, "entity", "inner" if filters else "left")
    order = ordering(sort, "entity", F.col("score").desc())
    return joined.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def market_first(hits: DataFrame, state: DataFrame, filters: tuple[Condition, ...], sort: tuple[str, bool], threshold: float, cut: int, limit: int = 20) -> DataFrame:
    """The first ``cut`` of the sorted state, of which those scored at least ``threshold`` stay, in the state's order."""
    order = ordering(sort)
    top = passing(state, filters).orderBy(*order).limit(cut)
    kept = top.join(hits.where(F.col("score") >= threshold), "entity")
    return kept.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def topn_subset(state: DataFrame, sort: tuple[str, bool], n: int, post: tuple[Condition, ...], scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The first ``n`` by a finite metric with their global ranks, then post-filters, then the score; nothing is filled up."""
    order = ordering(sort)
    top = state.where(finite(F.col(sort[0]))).orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return passing(top, post).join(scored.where(F.col("score") > threshold), "entity")


def scan_until(
    ordered: DataFrame,
    order: list[Column],
    judge: Callable[[list[str]], dict[str, float | None]],
    wanted: int,
    batch: int = 50,
    most_scanned: int = 1000,
) -> tuple[list[tuple[str, float]], dict]:
    """Pages an ordered pool through an expensive judge until ``wanted`` are confirmed.

    Only ``most_scanned`` entities ever reach the driver. A score above 0.5 is
    confirmed, below rejected; null, NaN or exactly 0.5 is unknown, never
    counted, and makes the answer incomplete, as do spent budgets.
    """
    pool = [r["entity"] for r in ordered.orderBy(*order).select("entity").limit(most_scanned + 1).collect()]
    more, pool = len(pool) > most_scanned, pool[:most_scanned]
    kept, scanned, unknown = [], 0, 0
    for at in range(0, len(pool), batch):
        page = pool[at : at + batch]
        scores = judge(page)
        for e in page:
            scanned += 1
            s = scores.get(e)
            if s is None or s != s or s == 0.5:
                unknown += 1
            elif s > 0.5:
                kept.append((e, s))
            if len(kept) == wanted:
                break
        if len(kept) == wanted:
            break
    stopped = "target_reached" if len(kept) == wanted else "scan_budget" if more else "pool_exhausted"
    return kept, {"scanned": scanned, "unknown": unknown, "stopped": stopped, "complete": unknown == 0 and stopped != "scan_budget"}


def chunked_scores(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], chunk: int = 100) -> DataFrame:
    """Adds score and live: chunks of at most ``chunk`` rows are scored on their own; a chunk whose scorer
    fails or answers out of line takes the median of all answered scores, and isn't live.

    Rows are (entity, ...); chunks are consecutive rows of a partition, so nothing is shuffled to score.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", score double, live boolean"

    def scored(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for at in range(0, len(b), chunk):
                part = b.iloc[at : at + chunk].copy()
                try:
                    s = pd.Series(scorer(part), index=part.index, dtype="float64")
                    if len(s) != len(part):
                        raise ValueError("misaligned")
                    part["score"], part["live"] = s.where(s.between(0, 1), 0.5), True
                except Exception:  # noqa: BLE001 - a failed chunk is filled, whatever failed
                    part["score"], part["live"] = None, False
                yield part

    answered = rows.mapInPandas(scored, schema)
    middle = answered.agg(F.percentile("score", F.lit(0.5)).alias("_middle"))
    return answered.crossJoin(F.broadcast(middle)).withColumn("score", F.coalesce("score", "_middle", F.lit(0.5))).drop("_middle")
