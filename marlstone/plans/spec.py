"""Structured queries over a state: filters, one sort, a limit; parsed, checked, compiled to columns.

Null is unknown: it passes no comparison, ``!=`` included, and sorts last in
either direction; ties go to the entity. A post-filter applies after the cut and
nothing fills the places it empties.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.runtime import staged

OPS = (">=", ">", "<=", "<", "==", "!=")
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


class SpecError(ValueError):
    """A query spec that can't be run; the message says why."""


@dataclass(frozen=True)
class Registry:
    """Fields by name with their kinds, and other names for them."""

    kinds: dict[str, str]
    aliases: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: object) -> str:
        found = name if name in self.kinds else self.aliases.get(str(name))
        if found not in self.kinds:
            raise SpecError(f"unknown field {name!r}")
        return found


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: float | bool

    def column(self) -> Column:
        c, v = F.col(self.field), F.lit(self.value)
        return {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v, "==": c == v, "!=": c != v}[self.op]


@dataclass(frozen=True)
class Spec:
    filters: tuple[Condition, ...] = ()
    sort: tuple[str, bool] | None = None
    limit: int = DEFAULT_LIMIT
    date: str | None = None
    post: tuple[Condition, ...] = ()


def _conditions(raw: object, registry: Registry) -> tuple[Condition, ...]:
    if raw is None:
        return ()
    if not isinstance(raw, list):
        raise SpecError("filters must be a list")
    out = []
    for f in raw:
        if not isinstance(f, dict) or f.get("op") not in OPS:
            raise SpecError(f"bad filter {f!r}")
        name, value = registry.resolve(f.get("field")), f.get("value")
        if registry.kinds[name] == "boolean":
            if f["op"] not in ("==", "!=") or not isinstance(value, bool):
                raise SpecError(f"{name} takes == or != with a boolean")
        elif isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            raise SpecError(f"{name} takes a number")
        out.append(Condition(name, f["op"], value))
    return tuple(out)


def parse(raw: object, registry: Registry) -> Spec:
    """A checked spec of ``{date, filters, sort, limit, post}``; raises SpecError."""
    if raw is None:
        return Spec()
    if not isinstance(raw, dict):
        raise SpecError("a spec is an object")
    sort = raw.get("sort")
    if sort is not None:
        if not isinstance(sort, dict) or sort.get("direction", "desc") not in ("asc", "desc"):
            raise SpecError(f"bad sort {sort!r}")
        sort = (registry.resolve(sort.get("field")), sort.get("direction", "desc") == "asc")
    limit = raw.get("limit", DEFAULT_LIMIT)
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT:
        raise SpecError(f"limit must lie in 1..{MAX_LIMIT}")
    date = raw.get("date")
    if date == "LATEST_TRADING_DAY":
        date = None
    if date is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(date)):
        raise SpecError(f"bad date {date!r}")
    return Spec(_conditions(raw.get("filters"), registry), sort, limit, date, _conditions(raw.get("post"), registry))


def passing(rows: DataFrame, conditions: tuple[Condition, ...]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [c.column() for c in conditions])) if conditions else rows


def ordering(sort: tuple[str, bool] | None, entity: str = "entity", *ties: Column) -> list[Column]:
    """Nulls last both ways, booleans as 0 and 1, then ``ties``, then the entity."""
    if sort is None:
        return [*ties, F.col(entity).asc()]
    name, ascending = sort
    return [F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last(), *ties, F.col(entity).asc()]


def at_date(state: DataFrame, date: str | None) -> DataFrame:
    """Rows of the given date, or of the latest in the data; never of today's clock."""
    if date is not None:
        return state.where(F.col("date") == F.lit(date).cast("date"))
    # each entity's last row, in the partitioning the state has, so the history is passed once
    last = staged(state.groupBy("entity").agg(F.max_by(F.struct(*state.columns), "date").alias("_s")).select("_s.*"), "last")
    latest = last.agg(F.max("date").alias("_latest"))
    return last.join(F.broadcast(latest), F.col("date") == F.col("_latest")).drop("_latest")


def run(state: DataFrame, spec: Spec, universe: DataFrame | None = None, comparison: tuple[str, str] | None = None) -> DataFrame:
    """Result rows with ``rank`` and ``total`` (rows before the limit).

    Order: date, filters, sort, limit, post-filters, then the comparison of a
    field with the previous calendar step's (its column ``prev_<field>``); what
    these drop is not filled. ``universe`` is joined on entity after the cut,
    rows without a match staying.
    """
    rows = staged(passing(at_date(state, spec.date), spec.filters), "rows")
    total = rows.agg(F.count("*").alias("total"))
    order = ordering(spec.sort)
    cut = rows.orderBy(*order).limit(spec.limit)
    ranked = cut.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    kept = passing(ranked, spec.post)
    if comparison is not None:
        name, op = comparison
        now, before = F.col(name), F.col(f"prev_{name}")
        kept = kept.where({">": now > before, ">=": now >= before, "<": now < before, "<=": now <= before}[op])
    kept = kept.crossJoin(F.broadcast(total))  # one row: the count
    return kept if universe is None else kept.join(universe, "entity", "left")
