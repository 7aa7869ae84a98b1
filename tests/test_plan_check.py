import pytest

from marlstone.plans import check
from marlstone.plans.phrases import parse_phrase
from marlstone.plans.spec import Registry

LIMITS = check.Limits(
    Registry({"amount": "number", "pct_change": "number", "is_up": "boolean", "volume_ratio": "number", "up_streak": "number", "market_cap": "number"}, {"成交额": "amount"}),
    frozenset({"amount", "pct_change", "volume_ratio"}), frozenset({"amount"}), {"pct_change": (-30, 30)}, frozenset({"advice", "future"}),
)


@pytest.mark.parametrize(
    ("plan", "wanted"),
    [
        ({"semantic": "光模块", "market": {"sort": {"field": "成交额", "direction": "desc"}, "limit": 20}}, []),
        ({"comparison": {"field": "amount", "op": ">"}}, []),
        ([], ["plan:not_an_object"]),
        ({}, ["plan:empty"]),
        ({"semantic": "光", "x": 1}, ["x:unknown_field", "semantic:length"]),
        ({"market": {"limit": 20}}, ["market.limit:nothing_to_rank_by"]),
        ({"market": {"sort": {"field": "market_cap", "direction": "up"}, "limit": 0}}, ["market.sort.field:not_sortable", "market.sort.direction:bad", "market.limit:range"]),
        ({"market": {"filters": [{"field": "pct_change", "op": ">", "value": 99}, {"field": "is_up", "op": ">", "value": True}, {"field": "no", "op": ">", "value": 1}, {"field": "amount", "op": "~", "value": 1}]}},
         ["market.filters:too_many", "market.filters.value:range", "market.filters.value:not_boolean", "market.filters.field:unknown", "market.filters.op:bad"]),
        ({"market": {"date": "2024-01-02", "sort": 3, "filters": 4}}, ["market.date:not_the_latest", "market.filters:not_a_list", "market.sort:not_an_object"]),
        ({"refused": {"intent": "advice", "detail": "x"}}, []),
        ({"refused": {"intent": "x", "detail": "y" * 201}, "semantic": "光模块"}, ["refused.intent:unknown", "refused.detail:length", "refused:beside_a_plan"]),
        ({"comparison": {"field": "pct_change", "op": "==", "day": 1}}, ["comparison.day:unknown_field", "comparison.field:not_comparable", "comparison.op:bad"]),
        ({"semantic": "光模块", "notes": ["n"] * 9}, ["notes:too_many"]),
    ],
)
def test_problems_of_plans(plan, wanted):
    assert check.problems(plan, LIMITS) == wanted


def test_scopes_and_captions():
    text = "成交额前20名里的光模块公司"
    plan = parse_phrase(text)
    assert check.selection(text, plan) == ("market_subset", 20) and check.problems(check.as_output(plan), LIMITS) == []
    text = "光模块公司，按领涨排"
    plan = parse_phrase(text)
    assert check.selection(text, plan) == ("business_topk", 20) and "by pct_change desc" in check.caption(plan)
    assert check.selection("明天哪些会涨", parse_phrase("明天哪些会涨")) is None and check.caption(parse_phrase("明天哪些会涨")) == "refused: future"
    assert check.caption(parse_phrase("成交额前50名中涨幅超过3%的")) .endswith("first 50; then pct_change > 3")
