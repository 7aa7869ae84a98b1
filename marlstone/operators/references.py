"""Orphan references: compressed bitmaps of keys, AND-NOT, decoded survivors.

Keys of both sides are numbered by a dictionary, a range-partitioned sort whose
partition offsets are all that reaches the driver. For each key range of 65,536
ids and each period of the reference's time three bitmaps are built: keys
referred to, keys whose parent exists at some instant of the period, and keys
whose parent exists throughout it. Bitmaps are containers of the usual two
kinds: a sorted array of 16-bit offsets up to 4,096 keys, 8 kB of bits beyond.

    referred AND NOT some        -> every row of that key and period is an orphan
    referred AND some AND NOT throughout -> the parent comes or goes within the
                                    period; these rows alone are compared with
                                    the parent's intervals, instant by instant
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.runtime import join_lookup, staged

RANGE_BITS = 16
ARRAY_MOST = 4096


def pack(offsets: np.ndarray) -> bytes:
    """Sorted unique 16-bit offsets as a container: tag byte 0 and an array, or 1 and 8 kB of bits."""
    if len(offsets) <= ARRAY_MOST:
        return b"\0" + offsets.astype("<u2").tobytes()
    bits = np.zeros(1 << RANGE_BITS, dtype=np.uint8)
    bits[offsets] = 1
    return b"\1" + np.packbits(bits).tobytes()


def unpack(container: bytes | None) -> np.ndarray:
    if not container:
        return np.zeros(0, dtype=np.uint16)
    if container[0] == 0:
        return np.frombuffer(container, dtype="<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8, offset=1))).astype(np.uint16)


def and_not(left: bytes | None, right: bytes | None) -> np.ndarray:
    """Offsets set in ``left`` and not in ``right``; two bit containers never leave their words."""
    if left and right and left[0] == right[0] == 1:
        a, b = (np.frombuffer(x, dtype=np.uint8, offset=1) for x in (left, right))
        return np.flatnonzero(np.unpackbits(a & ~b)).astype(np.uint16)
    return np.setdiff1d(unpack(left), unpack(right), assume_unique=True)


def dictionary(keys: DataFrame) -> DataFrame:
    """Columns key, id of the distinct non-null ``key`` values, ids dense and in key order.

    Sorted in ranges; the driver holds one count a partition. The ids are ranks,
    whatever ranges were drawn.
    """
    ranged = staged(keys.where(F.col("key").isNotNull()).distinct().repartitionByRange("key").select("key", F.spark_partition_id().alias("_p")), "dictionary")
    counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    start, starts = 0, {}
    for p in sorted(counts):
        starts[p], start = start, start + counts[p]
    if not starts:
        return ranged.select("key", F.lit(0).cast("long").alias("id"))
    offset = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), F.col("_p"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("key"))
    return ranged.select("key", (offset + rank - 1).cast("long").alias("id"))


def _containers(bits: DataFrame, name: str) -> DataFrame:
    """(range, period, container) of (id, period) rows; a group has at most 65,536 distinct offsets."""
    spread = bits.select(
        F.shiftright("id", RANGE_BITS).alias("range"), "period", F.col("id").bitwiseAND((1 << RANGE_BITS) - 1).cast("int").alias("offset")
    )
    lists = spread.groupBy("range", "period").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))

    @F.pandas_udf(T.BinaryType())
    def packed(offsets: pd.Series) -> pd.Series:
        return offsets.map(lambda x: pack(np.asarray(x, dtype=np.int64)))

    return lists.select("range", "period", packed("offsets").alias(name))


_BITS = "period long, id long, certain boolean"


def _survivors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for base, period, refs, some, whole in zip(batch["range"], batch["period"], batch["refs"], batch["some"], batch["whole"], strict=True):
            never = and_not(refs, some)
            partly = np.setdiff1d(and_not(refs, whole), never, assume_unique=True)
            for found, certain in ((never, True), (partly, False)):
                if len(found):
                    yield pd.DataFrame({"period": period, "id": (int(base) << RANGE_BITS) + found.astype(np.int64), "certain": certain})


def orphans(
    refs: DataFrame,
    parents: DataFrame,
    key: str,
    at: str,
    parent_key: str,
    since: str,
    until: str,
    unit: str = "month",
) -> DataFrame:
    """Rows of ``refs`` whose ``key`` no parent holds at the instant ``at``, with column ``period``.

    A parent row holds its key from ``since`` (null: never) until before
    ``until`` (null: for good); a key may have many such rows. Rows with a null
    key refer to nothing and never come out. Rows with a null instant are
    orphans if no parent ever had the key; their period is null. All columns of
    ``refs`` are kept, whatever their names; repeated rows come out each.
    """
    if unit not in ("month", "day", "year"):
        raise ValueError(unit)
    months = {"month": 1, "year": 12}.get(unit)

    def number(ts: str) -> F.Column:
        if unit == "day":
            return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return F.floor((F.year(ts) * 12 + F.month(ts) - 1) / months).cast("long")

    never = -(1 << 40)
    left = refs.where(F.col(key).isNotNull()).select(
        F.struct(*[F.col(f"`{c}`") for c in refs.columns]).alias("_row"), F.col(key).cast("string").alias("key"), F.col(at).alias("_at"), F.coalesce(number(at), F.lit(never)).alias("period")
    )
    held = parents.where(F.col(parent_key).isNotNull() & F.col(since).isNotNull() & (F.col(until).isNull() | (F.col(since) < F.col(until)))).select(
        F.col(parent_key).cast("string").alias("key"), F.col(since).alias("since"), F.col(until).alias("until")
    )
    seen = staged(left.groupBy("key", "period").agg(F.min("_at").alias("first"), F.max("_at").alias("last")), "refs")
    ids = staged(dictionary(seen.select("key").unionByName(held.select("key"))), "ids")
    times = seen.where(F.col("period") != never).agg(F.min("period"), F.max("period")).first()
    low, high = (times[0], times[1]) if times and times[0] is not None else (0, 0)

    spans = held.join(ids, "key").select("id", "since", "until", number("since").alias("a"), F.coalesce(number("until"), F.lit(high + 1)).alias("b"))
    inside = spans.where((F.col("b") >= low) & (F.col("a") <= high)).select(
        "id", "since", "until", F.explode(F.sequence(F.greatest("a", F.lit(low)), F.least("b", F.lit(high)))).alias("period"), "a", "b"
    )
    some = inside.select("id", "period").unionByName(spans.select("id", F.lit(never).cast("long").alias("period")))
    whole = inside.where((F.col("a") < F.col("period")) & (F.col("b") > F.col("period"))).select("id", "period")
    whole = whole.unionByName(spans.select("id", F.lit(never).cast("long").alias("period")))
    maps = (
        _containers(seen.join(ids, "key").select("id", "period"), "refs")
        .join(_containers(some, "some"), ["range", "period"], "left")
        .join(_containers(whole, "whole"), ["range", "period"], "left")
    )
    lost = staged(maps.mapInPandas(_survivors, _BITS).join(ids, "id").select("key", "period", "certain"), "lost")
    rows = join_lookup(left, lost, ["key", "period"])
    unsure = lost.where(~F.col("certain")).select("key").distinct()
    spans_of = join_lookup(held, unsure, ["key"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("since", "until")).alias("spans"))
    open_ = join_lookup(rows.where(~F.col("certain")), spans_of, ["key"], "left")
    alive = F.coalesce(F.exists("spans", lambda s: (s["since"] <= F.col("_at")) & (s["until"].isNull() | (F.col("_at") < s["until"]))), F.lit(False))
    out = rows.where("certain").select("_row", "period").unionByName(open_.where(~alive).select("_row", "period"))
    shown = out.select(F.when(F.col("period") != never, F.col("period")).alias("_period"), "_row")
    if unit == "day":
        label = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("_period").cast("int")), "yyyy-MM-dd")
    elif unit == "year":
        label = F.col("_period").cast("string")
    else:
        label = F.format_string("%04d-%02d", F.floor(F.col("_period") / 12), F.col("_period") % 12 + 1)
    return shown.select("_row.*", F.when(F.col("_period").isNotNull(), label).alias("orphan_period"))
