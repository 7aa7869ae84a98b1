"""A small grammar from Chinese phrases to a structured spec.

The parser walks a sentence once with one alternation of named clauses; each
match is read into the spec and cut out, and what remains is the semantic part of
the query. Nothing is guessed: a threshold needs an operator, a cut needs a
metric, and what can't be done is refused with a reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words for metrics, operators, units and sorts, as users write them.
METRICS = {
    "成交金额": "amount", "成交额": "amount", "成交量": "volume", "换手率": "turnover_rate", "换手": "turnover_rate", "量比": "volume_ratio",
    "市值": "market_cap", "收盘价": "close", "股价": "close", "涨跌幅": "pct_change", "涨幅": "pct_change", "跌幅": "pct_change",
}
FALLING = ("跌幅",)
BEFORE = {
    ">": "超过 大于 高于 超出 高出 多于 >".split(), ">=": "达到 不少于 不低于 至少 >= ≥".split(), "<": "不足 不到 低于 小于 少于 <".split(), "<=": "不超过 至多 不高于 <= ≤".split(),
}
AFTER = {">=": ("及以上", "以上"), "<=": ("及以下", "以下")}
UNITS = {"amount": {"亿": 1e8, "万": 1e4}, "volume": {"亿": 1e8, "万": 1e4}, "market_cap": {"万": 1e-4}}
SORTS = {
    "领涨": ("pct_change", False), "涨得最多": ("pct_change", False), "领跌": ("pct_change", True), "跌得最多": ("pct_change", True), "明显放量": ("volume_ratio", False),
    "交易活跃": ("amount", False), "交投活跃": ("amount", False),
}
REFUSED = {
    "advice": "该买 买入 推荐买 值得买 卖出".split(), "future": "明天 下周 未来 预测".split(), "injection": "忽略以上 忽略之前 ignore previous".split(), "either_or": ["或者", "或"],
}
COUNTERS = "家 只 个 名 支 位 强".split()
FIRST = ("排名前", "前", "top")
#: What before 前 makes it a time.
TIMES = ("之", "以", "目", "日", "天")
DATE_WORDS = "今日 今天 当前 当日 最新交易日".split()
ASKING = "帮我 请 找出 看看 有哪些 哪些".split()
WINDOWS = {"5": "return_5", "20": "return_20", "一周": "return_5", "一个月": "return_20"}
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2}
_WIDE = str.maketrans("０１２３４５６７８９", "0123456789")
_NUM = r"[0-9０-９]+(?:\.[0-9]+)?|[一二两三四五六七八九十]{1,3}"
_FLIP = {">": "<", ">=": "<=", "<": ">", "<=": ">="}


@dataclass
class Plan:
    filters: list[dict] = field(default_factory=list)
    post: list[dict] = field(default_factory=list)
    sort: dict | None = None
    limit: int | None = None
    comparison: tuple[str, str] | None = None
    semantic: str = ""
    refused: str | None = None
    notes: list[str] = field(default_factory=list)

    def spec(self) -> dict:
        """The plan as a spec; post-filters without a cut are plain filters."""
        out = {"filters": self.filters + ([] if self.limit else self.post), "post": self.post if self.limit else []}
        if self.sort:
            out["sort"] = self.sort
        if self.limit:
            out["limit"] = self.limit
        return out


def number(text: str) -> float | None:
    """1 to 99 in Chinese or full-width digits, or a plain decimal; None for anything else."""
    plain = text.translate(_WIDE).strip()
    if re.fullmatch(r"[0-9]+(\.[0-9]+)?", plain):
        return float(plain)
    m = re.fullmatch(r"([一二两三四五六七八九]?)(十?)([一二三四五六七八九]?)", plain)
    if not m or not plain or (m[1] and m[3] and not m[2]):
        return None
    return float((_DIGITS.get(m[1], 1) * 10 if m[2] else _DIGITS.get(m[1], 0)) + _DIGITS.get(m[3], 0))


def _any(words: list[str] | tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_BEFORE_OF = {w: op for op, ws in BEFORE.items() for w in ws}
_AFTER_OF = {w: op for op, ws in AFTER.items() for w in ws}
_CLAUSES = re.compile(
    rf"(?P<versus>(?P<vm>成交额|成交量|收盘价)(?P<vo>高于|超过|大于|低于|小于|少于)(?:前一天|前一日|昨天|昨日|上一交易日))"
    rf"|(?P<limit>(?P<lm>{_any(tuple(METRICS))})?(?P<lw>(?i:{_any(FIRST)}))\s*(?P<ln>{_NUM})\s*(?:{_any(COUNTERS)})?)"
    rf"|(?P<streak>连续\s*(?P<sn>{_NUM})\s*(?:个|天|日)*\s*(?:上涨|走高))"
    rf"|(?P<threshold>(?:(?:最近|近)\s*(?P<tw>{_NUM}|一周|一个月)\s*(?:个?交易日|天|日)?\s*(?:的)?)?(?P<tm>{_any(tuple(METRICS))})\s*(?P<to>{_any(tuple(_BEFORE_OF))})?\s*(?P<tn>-?(?:{_NUM}))\s*(?P<tu>万|亿)?\s*(?:元|%|％|倍|股)?\s*(?P<ta>{_any(tuple(_AFTER_OF))})?)"
    rf"|(?P<most>(?P<mm>{_any(tuple(METRICS))})最(?:大|高|多)|(?P<ms>{_any(tuple(SORTS))}))"
)
_JOINTS = re.compile(r"^(?:的|里|中|内|并且|且|而且|，|,|、|\s)+|(?:的公司|的企业|公司|企业|股票|概念|板块|里|中|内|的|类)+$")
_FILLER = re.compile(_any([*DATE_WORDS, *ASKING]) + "|[，,。？?！!]")


def parse_phrase(text: str) -> Plan:
    """The plan of a sentence; ``refused`` names why there is none."""
    plan = Plan()
    for reason, words in REFUSED.items():
        if any(w in text for w in words):
            plan.refused = reason
            return plan
    rest, at, cut = [], 0, False
    for m in _CLAUSES.finditer(text):
        if m["threshold"] and not (m["to"] or m["ta"]):
            continue  # a bare number beside a metric is no threshold
        if m["limit"] and text[: m.start("lw")].endswith(TIMES):
            continue  # before a time, not the first of an order
        rest.append(text[at : m.start()])
        at = m.end()
        if m["versus"]:
            plan.comparison = (METRICS[m["vm"]], ">" if m["vo"] in ("高于", "超过", "大于") else "<")
        elif m["limit"]:
            n = number(m["ln"])
            if n is None or not 1 <= n <= 100:
                plan.refused = "limit_out_of_range"
                return plan
            plan.limit, cut = int(n), True
            if m["lm"]:
                plan.sort = {"field": METRICS[m["lm"]], "direction": "asc" if m["lm"] in FALLING else "desc"}
        elif m["streak"]:
            (plan.post if cut else plan.filters).append({"field": "up_streak", "op": ">=", "value": number(m["sn"])})
        elif m["threshold"]:
            name, op = METRICS[m["tm"]], _AFTER_OF.get(m["ta"]) or _BEFORE_OF[m["to"]]
            value = number(m["tn"].lstrip("-")) * (-1 if m["tn"].startswith("-") else 1) * UNITS.get(name, {}).get(m["tu"], 1)
            if m["tw"]:
                key = m["tw"].translate(_WIDE)
                key = WINDOWS.get(key) or WINDOWS.get(str(int(number(key) or 0)))
                if key is None or name != "pct_change":
                    plan.refused = "unknown_window"
                    return plan
                name = key
            if m["tm"] in FALLING:
                op, value = _FLIP[op], -value
            (plan.post if cut else plan.filters).append({"field": name, "op": op, "value": value})
        else:
            found = SORTS[m["ms"]] if m["ms"] else (METRICS[m["mm"]], m["mm"] in FALLING)
            if plan.sort is None:
                plan.sort = {"field": found[0], "direction": "asc" if found[1] else "desc"}
            else:
                plan.notes.append(f"later sort {m.group()} left out")
    rest.append(text[at:])
    if plan.limit and plan.sort is None:
        plan.refused = "topn_without_metric"
    semantic = _FILLER.sub("", "".join(rest)).strip()
    while (shorter := _JOINTS.sub("", semantic)) != semantic:
        semantic = shorter
    plan.semantic = semantic
    return plan
