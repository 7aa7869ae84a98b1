"""Problem 7: mixing sources to target shares of all tokens.

Each record gets the key ``-ln(u) / weight`` of Efraimidis and Spirakis, with
``u`` from a hash of the record, so a rerun draws the same. Sorted by key within
its source, the prefix of records whose token sum stays within the budget is the
weighted sample; a record too large for what is left is passed over and the next
that fit fill the rest. What then is still open is closed by a subset sum over the
last records drawn and the next ones after them, ``POOL`` in all, so a few long
records can't leave a small source short. A source whose budget exceeds its size is used in complete
epochs first and only the remainder is drawn.

No source is ever sorted as a whole: token sums by key bin give the prefix sum up
to the bin in which the budget is reached; that bin is divided again until it
and its successors hold at most ``rank_rows`` records, and only those are ranked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.runtime import plain, staged

BINS = 1024
RANK_ROWS = 50_000
#: Sources at most; their targets are collected.
SOURCES = 10_000
#: Records drawn last, and records in all, among which the open rest of a budget is closed, and the largest rest looked at.
TAIL, POOL, REST = 24, 64, 1 << 22


def quality_weight(text: Column) -> Column:
    """A plain quality weight in [0.1, 1]: the share of letters and digits, less for very short texts."""
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce(letters / F.nullif(size, F.lit(0)), F.lit(0.0)) * F.least(F.lit(1.0), size / F.lit(200.0)))


def mix(
    records: DataFrame,
    targets: DataFrame,
    record_id: str,
    source: str,
    tokens: str,
    weight: str,
    total: int | None = None,
    seed: int = 11,
    rank_rows: int = RANK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: record, source, tokens, repeats >= 1. shares: source, target_share,
    available_tokens, max_repeats, budget_tokens, chosen_tokens, actual_share, limits_total (whether this
    source is what keeps the total from being larger).

    ``targets`` has source, targetshare, maxrepeats, one row a source (fixed and
    small: it is collected; more than ``SOURCES`` rows, or two of one source, are an
    error). ``total`` defaults to the most
    tokens at which no source needs more than its repeats; a larger ``total``
    leaves short sources at their cap, which the report shows. Sources without a
    target, or with a null name, are left out; sources with a target and no
    tokens get share 0. Records of null or zero tokens are never chosen. A null
    weight counts as the least. Repeated records are drawn each on its own.
    """
    spark = records.sparkSession
    rows = targets.where(F.col("source").isNotNull()).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"targets of more than {SOURCES} sources")
    wanted = {r["source"]: (float(r["targetshare"] or 0), int(r["maxrepeats"] or 0)) for r in rows}
    if len(wanted) < len(rows):
        raise ValueError("two targets of one source")
    key = F.xxhash64(F.col(record_id), F.col(tokens), F.lit(seed))
    unit = (F.shiftrightunsigned(key, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    base = staged(
        records.where(F.col(source).isin(list(wanted)) & (F.col(tokens) > 0)).select(
            F.col(record_id).alias("record"),
            F.col(source).alias("source"),
            F.col(tokens).cast("long").alias("tokens"),
            (-F.log(unit) / F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1e-6)), F.lit(1e-6))).alias("key"),
        ),
        "mix",
    )
    sums = {r["source"]: (int(r["t"]), float(r["high"])) for r in base.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("key").alias("high")).collect()}
    live = {s: w for s, w in wanted.items() if s in sums and w[0] > 0 and w[1] > 0}
    if total is None:
        total = min((int(rep * sums[s][0] / share) for s, (share, rep) in live.items()), default=0)
    limiting = {s for s, (share, rep) in live.items() if int(rep * sums[s][0] / share) <= total}
    budget = {s: min(int(round(share * total)), rep * sums[s][0]) for s, (share, rep) in live.items()}
    epochs = {s: b // sums[s][0] for s, b in budget.items()}
    rest = {s: b % sums[s][0] for s, b in budget.items()}

    # [low, high) of the bin in which the budget is reached, tokens before it, and its records
    span = {s: (0.0, math.nextafter(sums[s][1], math.inf), 0, None) for s, b in rest.items() if b > 0}
    busy, tail = dict(span), {}
    while busy:
        at = _lookup(spark, [(s, lo, hi) for s, (lo, hi, _, _) in busy.items()], "source string, lo double, hi double")
        found = (
            base.join(F.broadcast(at), "source")
            .where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
            .groupBy("source", F.least(F.lit(BINS - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int").alias("bin"))
            .agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
            .collect()
        )
        for s in list(busy):
            before, reached = busy[s][2], None
            for r in sorted((r for r in found if r["source"] == s), key=lambda r: r["bin"]):
                if reached is None and before + r["t"] >= rest[s]:
                    reached = span[s] = (r["first"], math.nextafter(r["last"], math.inf), before, r["n"])
                    tail[s], many = span[s][1], r["n"]
                elif reached is None:
                    before += r["t"]
                elif many + r["n"] <= rank_rows:
                    tail[s], many = math.nextafter(r["last"], math.inf), many + r["n"]
                else:
                    break
            if span[s][3] <= rank_rows or span[s][0] >= math.nextafter(span[s][1], -math.inf):
                del busy[s]
            else:
                busy[s] = span[s]

    plan = _lookup(
        spark,
        [(s, epochs[s], *((span[s][0], tail[s], rest[s] - span[s][2]) if s in span else (0.0, 0.0, 0))) for s in budget],
        "source string, epochs long, lo double, hi double, open long",
    )
    placed = base.join(F.broadcast(plan), "source")
    edge = placed.where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))).select("record", "source", "tokens", "key", "epochs", "open")

    def filled(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "record"], kind="stable")
        room, extra = int(group["open"].iloc[0]), []
        for size in group["tokens"].tolist():
            extra.append(size <= room)
            room -= size if size <= room else 0
        extra = closed(group["tokens"].tolist(), extra, room)
        return plain(pd.DataFrame({"record": group["record"], "source": group["source"], "tokens": group["tokens"], "repeats": group["epochs"] + np.array(extra, dtype=np.int64)}))

    drawn = edge.groupBy("source").applyInPandas(filled, T.StructType([base.schema["record"], base.schema["source"], base.schema["tokens"], T.StructField("repeats", T.LongType())]))
    outside = placed.where(~((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))))
    chosen = (
        outside.select("record", "source", "tokens", (F.col("epochs") + (F.col("key") < F.col("lo")).cast("long")).alias("repeats"))
        .unionByName(drawn)
        .where(F.col("repeats") > 0)
    )
    known = _lookup(
        spark,
        [(s, share, sums.get(s, (0, 0))[0], rep, budget.get(s, 0), s in limiting) for s, (share, rep) in wanted.items()],
        "source string, target_share double, available_tokens long, max_repeats int, budget_tokens long, limits_total boolean",
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("chosen_tokens"))
    shares = known.join(used, "source", "left").fillna(0, ["chosen_tokens"])
    everything = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.coalesce(F.col("chosen_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)))
    return chosen, shares


def closed(sizes: list[int], drawn: list[bool], room: int) -> list[bool]:
    """``drawn`` with the last records exchanged for such that leave less ``room``; earlier records are preferred among equal sums.

    The sums that can be reached are the bits of a number, one number after each record.
    """
    chosen, spare = [i for i, d in enumerate(drawn) if d], [i for i, d in enumerate(drawn) if not d]
    if not room or not spare:
        return drawn
    tail = chosen[-TAIL:]
    while tail and room + sum(sizes[i] for i in tail) > REST:
        tail = tail[1:]
    most = room + sum(sizes[i] for i in tail)
    if most > REST:
        return drawn
    free = tail + [i for i in spare if sizes[i] <= most][: POOL - len(tail)]
    reach, mask = [1], (1 << (most + 1)) - 1
    for i in free:
        reach.append(reach[-1] | (reach[-1] << sizes[i]) & mask)
    best, out = reach[-1].bit_length() - 1, list(drawn)
    for k in reversed(range(len(free))):
        out[free[k]] = not reach[k] >> best & 1
        best -= sizes[free[k]] * out[free[k]]
    return out


def _lookup(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a row a source; there are no more sources than rows of the targets."""
    return spark.createDataFrame(rows, schema)
