"""Column builders for names, addresses, display values and assembled texts. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.runtime import js_round

#: The provinces by short name, as they are looked for.
PROVINCES = "北京 天津 上海 重庆 河北 山西 辽宁 吉林 黑龙江 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 海南 四川 贵州 云南 陕西 甘肃 青海 台湾 内蒙古 广西 西藏 宁夏 新疆 香港 澳门".split()
#: Endings that a base form of a term is without.
ENDINGS = "业务 产品 类 行业 收入 板块 及扩展".split()


def first_listed(text: Column, names: list[str]) -> Column:
    """The first name of the list that stands in the text, else the empty string."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in names], F.lit(""))


def city_after(address: Column, province: Column) -> Column:
    """The first two to eight Han characters that end in 市 after the province, whose own suffix is passed over; empty if none."""
    at = F.call_function("locate", province, address)
    behind = F.regexp_replace(F.substring(address, at + F.length(province), F.lit(200)), "^(?:省|市|自治区|壮族自治区|回族自治区|维吾尔自治区)", "")
    return F.when((at > 0) & (province != ""), F.regexp_extract(behind, r"^([\x{4e00}-\x{9fff}]{1,7}?市)", 1)).otherwise("")


def aliases(name: Column, former: Column, most: int = 8) -> Column:
    """Other names: the name without marks of special treatment and without its legal form, and former names; without those
    equal to the name, empty ones and such as hold 公司, each once."""
    bare = F.regexp_replace(name, r"^\*?(?:ST|st)|[-－](?:U|W|UW)$", "")
    short = F.regexp_replace(bare, "(?:股份有限公司|有限责任公司|有限公司|集团|股份)$", "")
    every = F.concat(F.array(bare, short), F.coalesce(former, F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.length(x) > 1) & (x != name) & ~F.contains(x, F.lit("公司")))), 1, most)


def former_names(text: Column, most: int = 2) -> Column:
    """Names that the text says were changed (由…变更为, 曾用名…), without mere digits and such as hold 公司."""
    found = F.regexp_extract_all(text, F.lit(r"(?:由|曾用名[:：]?)[“\"「]?([\x{4e00}-\x{9fff}A-Za-z0-9*]{2,12}?)[”\"」]?(?:变更为|更名为|，|。|；)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~x.rlike("^[0-9]+$") & ~F.contains(x, F.lit("公司")))), 1, most)


def base_form(term: Column) -> Column:
    return F.regexp_replace(term, "(?:" + "|".join(ENDINGS) + ")$", "")


def clause_at(text: Column, at: Column) -> Column:
    """The clause around a place (1-based): from after the sign 。！？； before it to before the next."""
    left = F.regexp_extract(F.substring(text, 1, at - 1), "([^。！？；]*)$", 1)
    return F.concat(left, F.regexp_extract(F.substring(text, at, F.length(text)), "^([^。！？；]*)", 1))


def without_page_noise(text: Column) -> Column:
    """Lines without page numbers and short titles of reports."""
    lines = F.split(text, "\n")
    noise = lambda x: x.rlike(r"^\s*(?:第?\s*[0-9]+\s*(?:页|/\s*[0-9]+)?|[-—]\s*[0-9]+\s*[-—])\s*$") | (x.rlike("年度报告") & (F.length(F.trim(x)) <= 30))
    return F.array_join(F.filter(lines, lambda x: ~noise(x)), "\n")


def up_to_percent(text: Column, head: str, longest: int = 180, shortest: int = 20) -> Column:
    """The stretch from a head to the first per cent sign within ``longest`` characters, if it speaks of a share or a total."""
    found = F.regexp_extract(text, f"({head}[^%％]{{0,{longest}}}[%％])", 1)
    return F.when((F.length(found) >= shortest) & found.rlike("比例|总额"), found)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the [start, end) spans of an array of structs, from 0 and in order; overlaps are cut once."""
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(
        F.array_sort(spans), begin,
        lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))).alias("kept"), F.greatest(acc["at"], s["end"]).cast("int").alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def snippets(text: Column, terms: Column, around: int = 16, most: int = 3) -> Column:
    """Up to ``most`` surroundings, one a term that stands in the text, on one line, with ellipses where cut."""
    flat = F.regexp_replace(text, r"\s+", " ")

    def one(t: Column) -> Column:
        at = F.call_function("locate", t, flat)
        start, stop = F.greatest(F.lit(1), at - around), F.least(F.length(flat), at + F.length(t) - 1 + around)
        return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), F.substring(flat, start, stop - start + 1), F.when(stop < F.length(flat), "…").otherwise("")))

    return F.slice(F.array_compact(F.transform(terms, one)), 1, most)


def display(value: Column, kind: str) -> Column:
    """A value as it is shown, rounded half up: money in 亿 or 万, shares in per cent, streaks and ratios with their unit; null as a dash."""
    v = value.cast("double")
    two = lambda x: F.format_string("%.2f", js_round(x, 2))
    shown = {
        "money": F.when(F.abs(v) >= 1e8, F.concat(two(v / 1e8), F.lit("亿"))).when(F.abs(v) >= 1e4, F.concat(two(v / 1e4), F.lit("万"))).otherwise(two(v)),
        "percent": F.concat(F.when(v > 0, "+").otherwise(""), two(v), F.lit("%")),
        "streak": F.concat(F.format_string("%.0f", v), F.lit("连板")),
        "ratio": F.concat(two(v), F.lit("倍")),
    }[kind]
    return F.when(v.isNull() | F.isnan(v), "—").otherwise(shown)


def labelled_lines(parts: list[tuple[str, Column]], cap: int, tail: tuple[str, Column] | None = None, each: int | None = None) -> Column:
    """Lines ``label：value`` in the given order, empty values left out, each value at most ``each`` characters; ``tail`` fills what room is left to ``cap``."""
    line = lambda label, v: F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(label + "："), F.substring(v, 1, each) if each else v))
    head = F.substring(F.concat_ws("\n", *[line(label, v) for label, v in parts]), 1, cap)
    if tail is None:
        return head
    room = F.lit(cap) - F.length(head) - len(tail[0]) - 2
    more = F.when((room > 0) & (F.length(F.trim(tail[1])) > 0), F.concat(F.lit("\n" + tail[0] + "："), F.substring(tail[1], F.lit(1), room)))
    return F.concat(head, F.coalesce(more, F.lit("")))


def ordered_once(lists: list[Column], drop: str, most: int) -> Column:
    """The members of several lists in order, trimmed, without blanks and those that match ``drop``, each once, at most ``most``."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.slice(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.rlike(drop))), 1, most)


def by_dimension(items: Column, order: list[str], dimension: str) -> Column:
    """An array of structs sorted by where their dimension stands in a list, unknown ones last; otherwise as they stood."""
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(d) for d in order]), s[dimension]), F.lit(0).cast("long")), F.lit(len(order) + 1).cast("long"))
    keyed = F.transform(items, lambda s, i: F.struct(place(s).alias("p"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def first_needle(text: Column, tags: dict[str, list[str]], other: str = "other") -> Column:
    """The first tag any of whose needles stands in the text."""
    tests = [F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles]), F.lit(tag)) for tag, needles in tags.items()]
    return F.coalesce(*tests, F.lit(other))


def relative_start(now: Column, span: str) -> Column:
    """The time a span like 7d, 24h or 30m before ``now``."""
    n, unit = int(span[:-1]), {"d": "days", "h": "hours", "m": "mins"}[span[-1]]
    return now - F.make_dt_interval(**{unit: F.lit(n)})


def local_time(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """A UTC time as local text with its offset."""
    return F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at), "yyyy-MM-dd HH:mm:ss"), F.lit("+08:00" if zone == "Asia/Shanghai" else ""))
