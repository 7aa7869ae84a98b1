"""Texts for corpus counts, without what repetition alone makes common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.runtime import staged

#: A text counts once if it has more copies than that, and more than this part of all rows.
COPIES, OFTEN = 20, 100_000


def once_each(rows: DataFrame, text: str) -> DataFrame:
    """The texts, those of more than ``COPIES`` rows and a share of more than 1 / ``OFTEN`` once, others as often as they stand.

    There are fewer than ``OFTEN`` such texts, so their 64-bit hashes may be broadcast; only they are shuffled, merged before.
    """
    hashed = rows.select(F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    copies = staged(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > COPIES), "copies")
    least = rows.count() / OFTEN if copies.limit(1).count() else 0
    often = F.broadcast(copies.where(F.col("_n") > least).select("_h"))
    rest = hashed.join(often, "_h", "left_anti").select("text")
    return rest.unionByName(hashed.join(often, "_h", "left_semi").select("text").distinct())
