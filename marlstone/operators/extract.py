"""Evidence from long texts and web pages: sentences, windows around triggers, terms of cells, hits by field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.columns import uncontained
from marlstone.runtime import plain

# Parts of a page that hold no content, marks that end a sentence, and the longest snaps.
SILENT = {"script", "style", "noscript", "header", "footer", "nav", "template"}
ENDS = "。！？；!?"
BEFORE, AFTER, REACH, SHORTEST = 60, 100, 40, 12


class _Lines(HTMLParser):
    """Text of a page outside silent parts, a line a text node; a real tokenizer, so markup inside scripts stays inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            self.lines.append(" ".join(data.split()))


def sentences_of(page: str | None) -> list[str]:
    """Sentences of a page's visible text, in order, once each; broken markup gives what can be read."""
    if not page:
        return []
    reader = _Lines()
    reader.feed(page)
    reader.close()
    out = (s.strip() for line in reader.lines for s in re.split(f"(?<=[{ENDS}])", line))
    return list(dict.fromkeys(s for s in out if s))


def page_sentences(pages: DataFrame, entity: str, html: str, must: str, never: str = "(?!)", shortest: int = 10, longest: int = 160, per_page: int = 4) -> DataFrame:
    """entity, sentence, position: of each page the first ``per_page`` sentences of the given lengths that match ``must``
    and not ``never``, none containing another. Null and empty pages give none."""
    kind = dict(pages.dtypes)[entity]
    wanted, unwanted = re.compile(must), re.compile(never)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, page in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                kept: list[str] = []
                for s in sentences_of(page):
                    if len(kept) < per_page and shortest <= len(s) <= longest and wanted.search(s) and not unwanted.search(s) and not any(s in k or k in s for k in kept):
                        kept.append(s)
                rows += [(key, s, i) for i, s in enumerate(kept)]
            if rows:
                yield plain(pd.DataFrame(rows, columns=["entity", "sentence", "position"]))

    return pages.select(entity, html).mapInPandas(read, f"entity {kind}, sentence string, position int")


def snapped(text: str, start: int, end: int) -> tuple[int, int]:
    """A window with each end moved out to the nearest sentence end within reach, or left where it is."""
    left, right = max(0, start - BEFORE), min(len(text), end + AFTER)
    before = max((text.rfind(c, max(0, left - REACH), left) for c in ENDS), default=-1)
    left = before + 1 if before >= 0 else 0 if left <= REACH else left
    after = [i for i in (text.find(c, right, right + REACH) for c in ENDS) if i >= 0]
    right = min(after) + 1 if after else len(text) if right + REACH >= len(text) else right
    return left, right


def trigger_windows(rows: DataFrame, entity: str, text: str, triggers: dict[str, str], rejects: dict[str, str]) -> DataFrame:
    """entity, category, at, window, reason: every occurrence of every trigger pattern with its snapped window; reason
    names the first reject pattern that matches it, or ``short``, and is null for evidence. Positions are from 0."""
    kind = dict(rows.dtypes)[entity]
    found = [(name, re.compile(p)) for name, p in triggers.items()]
    guards = [(name, re.compile(p)) for name, p in rejects.items()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                for name, pattern in found:
                    for m in pattern.finditer(t or ""):
                        start, end = snapped(t, m.start(), m.end())
                        window = t[start:end]
                        why = "short" if len(window) < SHORTEST else next((g for g, p in guards if p.search(window)), None)
                        out.append((key, name, m.start(), window, why))
            if out:
                yield plain(pd.DataFrame(out, columns=["entity", "category", "at", "window", "reason"]))

    return rows.select(entity, text).mapInPandas(scan, f"entity {kind}, category string, at int, window string, reason string")


def chosen_windows(windows: DataFrame, most: int = 6) -> DataFrame:
    """entity, windows: accepted windows in order of position, none within another, at most ``most``. Equal windows are merged
    before an entity's are gathered; all that differ are looked at."""
    each = windows.where(F.col("reason").isNull()).groupBy("entity", "window").agg(F.min(F.struct("at", "category")).alias("_r"))
    lists = each.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "window"))), lambda s: s["window"]).alias("x"))
    return lists.select("entity", uncontained(F.col("x"), most).alias("windows"))


def split_terms(value: str | None, shortest: int = 2, longest: int = 24) -> list[str]:
    """Terms of a cell, separated outside brackets; residual buckets like 其他 and terms of other lengths are left out."""
    out, depth, now = [], 0, ""
    for ch in (value or "") + "、":
        depth = max(0, depth + (ch in "（([【") - (ch in "）)]】"))
        if depth == 0 and ch in "、，,；;/|\n":
            term = now.strip()
            if shortest <= len(term) <= longest and not re.fullmatch(r"其[他它].*|合计|小计", term):
                out.append(term)
            now, depth = "", 0
        else:
            now += ch
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def terms_of(cells: pd.Series) -> pd.Series:
    return cells.map(split_terms)


def cell_term(cell: Column) -> Column:
    """The last part of a cell like 其中:A-B, which is a part of the cell; null where nothing is left or it is a residual bucket."""
    bare = F.regexp_replace(F.trim(cell), "^其中[:：]", "")
    term = F.trim(F.regexp_extract(bare, r"([^\-－—]*)$", 1))
    term = F.when(term == "", F.trim(F.regexp_extract(bare, r"^([^\-－—]*)", 1))).otherwise(term)
    return F.when((F.length(term) >= 2) & ~term.rlike("^其[他它]"), term)


def field_hits(rows: DataFrame, key: str, fields: list[str], terms: list[str], around: int = 18) -> DataFrame:
    """key, field, quote, term: each field of a row that holds a term, with its first surroundings; a quote of a field once, with its least term."""
    each = rows.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x"))
    hit = each.select("key", "x.field", "x.text", F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("x.text"), t))).alias("term"))
    at = F.call_function("locate", F.col("term"), F.col("text"))
    start = F.greatest(F.lit(1), at - around)
    quote = F.substring(F.col("text"), start, at - start + F.length("term") + around)
    return hit.groupBy("key", "field", quote.alias("quote")).agg(F.min("term").alias("term"))


def in_context(rows: DataFrame, key: str, text: str, term: str, before: int = 90, after: int = 170, most: int = 4) -> DataFrame:
    """key, n, quote: the first ``most`` occurrences of a term, whatever its case, with what stands around them."""
    pieces = F.split(F.lower(F.col(text)), F.lit(f"\\Q{term.lower()}\\E"))
    ends = F.aggregate(
        F.slice(pieces, F.lit(1), F.least(F.lit(most), F.greatest(F.size(pieces) - 1, F.lit(0)))),
        F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(term), F.lit(0)) + F.length(p)).cast("int"))),
    )
    spots = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("_t"), F.posexplode(ends).alias("n", "_at"))
    start = F.greatest(F.lit(0), F.col("_at") - before)
    return spots.select("key", "n", F.substring(F.col("_t"), start + 1, F.col("_at") - start + len(term) + after).alias("quote"))
