"""Checks of a compiled plan from outside, the scope it selects in, and a caption of what it does.

A plan is an object with semantic (text or null), market (filters, post, sort, limit, date),
comparison (field, op), refused (intent, detail) and notes; every field may be missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from marlstone.plans.phrases import Plan
from marlstone.plans.spec import DEFAULT_LIMIT, MAX_LIMIT, OPS, Registry, SpecError

#: How many conditions of either kind, notes, and characters of text and refusals a plan may have.
MOST = {"filters": 3, "post": 2, "notes": 8, "semantic": (2, 60), "detail": 200}
COMPARED = (">", ">=", "<", "<=")
#: Words by which a phrase says that the business condition applies to the cut of the market, not the other way round.
SUBSET_WORDS = ("之中", "当中", "里面", "里", "中的", "全市场", "全部股票", "所有股票")


@dataclass(frozen=True)
class Limits:
    """What the data allow: fields that may be sorted by, that may be compared with the day before, ranges of values, and intents of refusals."""

    registry: Registry
    sortable: frozenset[str]
    compared: frozenset[str]
    ranges: dict[str, tuple[float, float]]
    intents: frozenset[str]


def problems(plan: object, limits: Limits) -> list[str]:
    """Why a plan can't be run, as ``place:reason``; an empty list means it can."""
    if not isinstance(plan, dict):
        return ["plan:not_an_object"]
    out = [f"{k}:unknown_field" for k in plan if k not in ("semantic", "market", "comparison", "refused", "notes")]
    refused, market, versus = plan.get("refused"), plan.get("market"), plan.get("comparison")
    out += _refusal(refused, limits)
    semantic = plan.get("semantic")
    if semantic is not None and not isinstance(semantic, str):
        out.append("semantic:not_text")
    elif semantic and not MOST["semantic"][0] <= len(semantic) <= MOST["semantic"][1]:
        out.append("semantic:length")
    notes = plan.get("notes")
    if notes is not None and (not isinstance(notes, list) or any(not isinstance(n, str) for n in notes)):
        out.append("notes:not_texts")
    elif notes and len(notes) > MOST["notes"]:
        out.append("notes:too_many")
    if market is not None:
        out += _market(market, limits) if isinstance(market, dict) else ["market:not_an_object"]
    if versus is not None:
        out += _comparison(versus, limits)
    if refused is not None:
        if semantic is not None or market is not None or versus is not None:
            out.append("refused:beside_a_plan")
        return out
    own = market if isinstance(market, dict) else {}
    ranks = bool(own.get("sort") or own.get("filters") or versus)
    if not semantic and not versus and not any(own.get(k) for k in ("filters", "post", "sort", "limit")):
        out.append("plan:empty")
    if own.get("limit") is not None and not ranks:
        out.append("market.limit:nothing_to_rank_by")
    return out


def _refusal(refused: object, limits: Limits) -> list[str]:
    if refused is None:
        return []
    if not isinstance(refused, dict) or not isinstance(refused.get("intent"), str) or not isinstance(refused.get("detail"), str):
        return ["refused:form"]
    return ["refused.intent:unknown"] * (refused["intent"] not in limits.intents) + ["refused.detail:length"] * (len(refused["detail"]) > MOST["detail"])


def _market(market: dict, limits: Limits) -> list[str]:
    out = [f"market.{k}:unknown_field" for k in market if k not in ("date", "filters", "post", "sort", "limit")]
    if market.get("date") not in (None, "LATEST_TRADING_DAY"):
        out.append("market.date:not_the_latest")
    for kind in ("filters", "post"):
        out += _conditions(market.get(kind), f"market.{kind}", MOST[kind], limits)
    sort = market.get("sort")
    if sort is not None:
        if not isinstance(sort, dict):
            out.append("market.sort:not_an_object")
        else:
            out += [f"market.sort.{k}:unknown_field" for k in sort if k not in ("field", "direction")]
            name = _field(sort.get("field"), limits)
            out += ["market.sort.field:unknown"] if name is None else ["market.sort.field:not_sortable"] * (name not in limits.sortable)
            out += ["market.sort.direction:bad"] * (sort.get("direction") not in ("asc", "desc"))
    limit = market.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_LIMIT):
        out.append("market.limit:range")
    return out


def _field(name: object, limits: Limits) -> str | None:
    try:
        return limits.registry.resolve(name)
    except SpecError:
        return None


def _conditions(conditions: object, place: str, most: int, limits: Limits) -> list[str]:
    if conditions is None:
        return []
    if not isinstance(conditions, list):
        return [f"{place}:not_a_list"]
    out = [f"{place}:too_many"] * (len(conditions) > most)
    for c in conditions:
        name = _field(c.get("field"), limits) if isinstance(c, dict) else None
        if name is None:
            out.append(f"{place}.field:unknown")
            continue
        value, kind = c.get("value"), limits.registry.kinds[name]
        if c.get("op") not in OPS:
            out.append(f"{place}.op:bad")
        elif kind == "boolean":
            out += [f"{place}.value:not_boolean"] * (not isinstance(value, bool) or c["op"] not in ("==", "!="))
        elif isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            out.append(f"{place}.value:not_a_number")
        elif name in limits.ranges and not limits.ranges[name][0] <= value <= limits.ranges[name][1]:
            out.append(f"{place}.value:range")
    return out


def _comparison(versus: object, limits: Limits) -> list[str]:
    if not isinstance(versus, dict):
        return ["comparison:not_an_object"]
    out = [f"comparison.{k}:unknown_field" for k in versus if k not in ("field", "op")]
    name = _field(versus.get("field"), limits)
    return out + ["comparison.field:not_comparable"] * (name not in limits.compared) + ["comparison.op:bad"] * (versus.get("op") not in COMPARED)


def as_output(plan: Plan) -> dict:
    """A parsed phrase in the form that ``problems`` checks."""
    if plan.refused:
        return {"refused": {"intent": plan.refused, "detail": plan.refused}}
    spec = plan.spec()
    market = {k: v for k, v in (("filters", spec["filters"]), ("post", spec["post"]), ("sort", spec.get("sort")), ("limit", spec.get("limit"))) if v}
    versus = {"field": plan.comparison[0], "op": plan.comparison[1]} if plan.comparison else None
    return {k: v for k, v in (("semantic", plan.semantic or None), ("market", market or None), ("comparison", versus), ("notes", plan.notes or None)) if v is not None}


def selection(text: str, plan: Plan) -> tuple[str, int] | None:
    """(scope, limit) of a plan with both a business and a market part: ``market_subset`` where the cut of the market comes first,
    as its words or a condition after the cut say, else ``business_topk``; None where there is nothing to choose."""
    market = plan.filters or plan.post or plan.sort or plan.limit
    if plan.refused or not plan.semantic or not market:
        return None
    inside = any(w in text for w in SUBSET_WORDS) or bool(plan.post)
    return ("market_subset" if inside else "business_topk"), plan.limit or DEFAULT_LIMIT


def caption(plan: Plan) -> str:
    """What a plan does, in the order it does it."""
    if plan.refused:
        return f"refused: {plan.refused}"
    condition = lambda c: f"{c['field']} {c['op']} {c['value']:g}"
    parts = [f"business: {plan.semantic}"] * bool(plan.semantic) + [condition(c) for c in plan.filters]
    if plan.sort:
        parts.append(f"by {plan.sort['field']} {plan.sort['direction']}")
    if plan.limit:
        parts.append(f"first {plan.limit}")
    parts += [f"then {condition(c)}" for c in plan.post]
    if plan.comparison:
        parts.append(f"{plan.comparison[0]} {plan.comparison[1]} the day before")
    return "; ".join(parts)
