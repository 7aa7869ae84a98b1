"""Column builders with exact semantics: text, arrays, percentiles. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_HAN = r"[^\x{3400}-\x{9fff}]+"
#: Patterns that hide addresses, numbers and keys, in the order they are applied, with their marks.
MASKS = (
    (r"(?i)([?&][a-z_]*(?:key|token|secret|password|signature|sig)=)[^&#\s]+", "$1[key]"),
    (r"(?i)\b([a-z_]*(?:key|token|secret|password|passwd|pwd))\s*[=:]\s*[^\s,;&\[]+", "$1=[key]"),
    (r"(?i)bearer\s+[a-z0-9._\-]+", "[token]"),
    (r"(?i)\b(?:sk|pk|key)-[a-z0-9]{8,}", "[key]"),
    (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "[phone]"),
    (r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])", "[id]"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[ip]"),
    (r"(?i)/(?:home|users)/[^/\s]+", "/[home]"),
    (r"(?i)[a-z]:\\users\\[^\\\s]+", "[home]"),
)


def lex_tokens(text: Column) -> Column:
    """Lower-cased ``[a-z0-9]+`` runs, then bigrams of the Han characters taken together (so a bigram may
    bridge what stood between), then the characters; null gives an empty list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    han = F.filter(F.split(F.regexp_replace(low, NOT_HAN, ""), ""), lambda c: c != "")

    def with_pairs(h: Column) -> Column:
        rest = F.greatest(F.size(h) - 1, F.lit(0))
        return F.concat(F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(2), rest), lambda a, b: F.concat(a, b)), h)

    # bound to a variable, the characters are taken once and not wherever they are named
    return F.concat(words, F.get(F.transform(F.array(han), with_pairs), F.lit(0)))


def short_hash(text: Column) -> Column:
    """First 16 digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def mask(text: Column) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), MASKS, text)


def is_corrupt(text: Column) -> Column:
    """Holds a replacement or a control character."""
    return F.coalesce(text.rlike(r"[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(False))


def han_ratio(text: Column) -> Column:
    """Share of Han characters, null for empty."""
    return F.length(F.regexp_replace(text, NOT_HAN, "")) / F.nullif(F.length(text), F.lit(0))


def snap_window(text: Column, at: Column, width: Column, before: int = 60, after: int = 100, reach: int = 40) -> Column:
    """The text from ``before`` characters before ``at`` (1-based) to ``after`` behind its end, each end moved out to the
    nearest sentence end within ``reach`` more characters, or left where it is."""
    left = F.greatest(F.lit(1), at - before)
    right = F.least(F.length(text), at + width - 1 + after)
    ahead = F.substring(text, F.greatest(F.lit(1), left - reach), left - F.greatest(F.lit(1), left - reach))
    tail = F.length(F.regexp_extract(ahead, r"([^。！？；]*)$", 1))
    begins = F.when(F.length(ahead) > tail, left - tail).when(left - reach <= 1, F.lit(1)).otherwise(left)
    behind = F.substring(text, right + 1, F.lit(reach))
    stop = F.length(F.regexp_extract(behind, r"^([^。！？；]*[。！？；])", 1))
    ends = F.when(stop > 0, right + stop).when(right + reach >= F.length(text), F.length(text)).otherwise(right)
    return F.substring(text, begins, ends - begins + 1)


def term_hits(text: Column, terms: Column) -> Column:
    """The terms that stand in the text, in their order, once each."""
    return F.array_distinct(F.filter(terms, lambda t: F.contains(text, t)))


def snippet(text: Column, term: Column, around: int = 16) -> Column:
    """``term`` with its surroundings on one line, ellipses where cut; null if it isn't there."""
    flat = F.regexp_replace(text, r"\s+", " ")
    at = F.call_function("locate", term, flat)
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(flat), at + F.length(term) - 1 + around)
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.substring(flat, start, stop - start + 1), F.when(stop < F.length(flat), F.lit("…")).otherwise(F.lit(""))))


def budgeted(items: Column, cap: int, skip: bool) -> Column:
    """The strings of an array, in order, while their lengths sum to at most ``cap``: with ``skip`` an item
    that doesn't fit is passed over, otherwise it ends the list. A fold, so nothing leaves the JVM."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("int").alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + F.length(x) <= cap) & ~acc["done"]
        return F.struct(
            F.when(fits, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, (acc["used"] + F.length(x)).cast("int")).otherwise(acc["used"]).alias("used"),
            (acc["done"] | (F.lit(not skip) & ~fits)).alias("done"),
        )

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def uncontained(items: Column, cap: int) -> Column:
    """The strings of an array, in order, that neither contain nor are contained in one kept before; at most ``cap``."""
    start = F.array().cast("array<string>")

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda k: F.contains(k, x) | F.contains(x, k))
        return F.when((F.size(kept) < cap) & ~clash, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(items, start, step)


def spans_within(items: Column, cap: int, most: int) -> Column:
    """The strings of an array, in order, that fit what is left of ``cap`` characters and neither contain nor are
    contained in one kept before; at most ``most``. What isn't kept takes no slot and no characters."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("int").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc["kept"], lambda k: F.contains(k, x) | F.contains(x, k))
        takes = (F.size(acc["kept"]) < most) & (acc["used"] + F.length(x) <= cap) & ~clash
        return F.when(takes, F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["used"] + F.length(x)).cast("int").alias("used"))).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def nearest_rank(sorted_values: Column, share: float, variant: str) -> Column:
    """An element of a sorted array by one of the usual rules; null for an empty one.

    round_up: [clamp(round(p n) - 1)], halves up; ceil: [ceil(p n) - 1]; round_span: [round(p (n - 1))],
    halves to even; floor: [min(n - 1, floor(p n))].
    """
    n = F.size(sorted_values)
    return F.when(n > 0, F.get(sorted_values, rank_position(n, share, variant).cast("int")))


def rank_position(n: Column, share: float, variant: str) -> Column:
    """Where in ``n`` sorted values, from 0, ``nearest_rank`` finds its element."""
    at = {
        "round_up": F.floor(n * F.lit(share) + 0.5) - 1,
        "ceil": F.ceil(n * F.lit(share)) - 1,
        "round_span": F.bround((n - 1) * F.lit(share)),
        "floor": F.floor(n * F.lit(share)),
    }[variant]
    return F.greatest(F.lit(0), F.least(n - 1, at))


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded half up; null where whole is 0."""
    scale = float(10**digits)
    return F.when(whole > 0, F.floor(part / F.nullif(whole, F.lit(0)) * scale + 0.5) / scale)


def null_if_any(total: Column, rows: Column, known: Column) -> Column:
    """A sum that is unknown as soon as one addend is."""
    return F.when(rows == known, total)
