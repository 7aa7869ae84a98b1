"""Validators: the issues of documents, profiles and benchmark cases, one row an issue, and small checks of bars and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """The keys and issue: a row for each check a row meets, unknown being not met; a row without issues has none."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return rows.select(*keys, F.explode(marks).alias("issue"))


def document_checks(text: Column, size: Column, title: Column, published: Column, fetched: Column, longest: int = 20_000) -> dict[str, Column]:
    """A document has text, of the length it says, not too long; a title that isn't its whole text; and isn't fetched before it was published."""
    return {
        "no_text": text.isNull() | (F.trim(text) == ""),
        "too_long": F.length(text) > longest,
        "length_differs": F.length(text) != size,
        "no_title": title.isNull() | (F.trim(title) == ""),
        "title_is_text": title == text,
        "no_date": published.isNull(),
        "fetched_before_published": fetched < published,
    }


def profile_checks(named: Column, excluded: Column, known: Column, covered: Column, missing: Column) -> dict[str, Column]:
    """Labels of a profile are known ones; none is both named and excluded; what is missing is exactly what isn't covered."""
    return {
        "unknown_label": F.size(F.array_except(named, known)) > 0,
        "contradiction": F.arrays_overlap(named, excluded),
        "no_label": F.size(named) == 0,
        "coverage_not_exact": (F.size(F.array_intersect(covered, missing)) > 0) | (F.size(F.array_except(known, F.array_union(covered, missing))) > 0),
    }


def complement(known: list[str], covered: Column) -> Column:
    """The known dimensions that aren't covered, in their order."""
    return F.array_except(F.array(*[F.lit(k) for k in known]), F.coalesce(covered, F.array().cast("array<string>")))


def case_checks(query: Column, best: Column, good: Column, split: Column, splits: list[str]) -> dict[str, Column]:
    """A benchmark case has a query and relevant items, none of them in two grades or twice in one, and a known split."""
    return {
        "no_query": query.isNull() | (F.trim(query) == ""),
        "no_relevant": F.size(F.coalesce(best, F.array().cast("array<string>"))) == 0,
        "in_two_grades": F.arrays_overlap(best, good),
        "repeated": F.size(F.array_distinct(best)) < F.size(best),
        "unknown_split": ~split.isin(splits),
    }


def mean_price_fits(low: Column, high: Column, amount: Column, volume: Column, slack: float = 0.01) -> Column:
    """Whether amount over volume lies between low and high, with some slack; null without volume."""
    price = amount / F.nullif(volume, F.lit(0.0))
    return (price >= low * (1 - slack)) & (price <= high * (1 + slack))


def margin(revenue: Column, cost: Column) -> Column:
    """Share of revenue that costs leave, null where either is missing or revenue is 0."""
    return F.when(revenue != 0, (revenue - cost) / revenue)


def ordered_hash(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The group and hash: of its rows in order, the given columns joined. A group is a page of results, not a table."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lists = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("l"))
    return lists.select(group, F.substring(F.sha2(F.array_join(F.transform("l", lambda s: s["r"]), ";"), 256), 1, 16).alias("hash"))


def vocabulary(rows: DataFrame, value: str, most: int = 250) -> DataFrame:
    """value, n: the commonest values, ties by value."""
    return rows.where(F.col(value).isNotNull() & (F.trim(value) != "")).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(most)
