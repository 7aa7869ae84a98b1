"""Reading and writing the engine's files: day files, tolerant event logs, fixed-width binaries, increments."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_day_files(spark: SparkSession, folder: str, schema: T.StructType, date: str = "date", since: str | None = None, until: str | None = None) -> DataFrame:
    """JSON lines in files named ``<yyyy-MM-dd>.jsonl``. A row whose date isn't its file's fails the query.

    ``since`` and ``until`` (inclusive) choose whole files by name.
    """
    day = F.regexp_extract("_metadata.file_name", r"^(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
    rows = spark.read.schema(schema).json(folder, pathGlobFilter="*.jsonl").withColumn("_day", day)
    if since is not None:
        rows = rows.where(F.col("_day") >= since)
    if until is not None:
        rows = rows.where(F.col("_day") <= until)
    same = F.col(date).cast("string").eqNullSafe(F.col("_day"))
    return rows.withColumn(date, F.when(same, F.col(date)).otherwise(F.raise_error(F.concat(F.lit("row of another date in "), F.col("_day"))))).drop("_day")


def read_events(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(events, corrupt): parsed lines, and one row with the number of lines that aren't JSON; blank lines are neither."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(folder, pathGlobFilter="*.jsonl", recursiveFileLookup=True).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return parsed.where(F.col("e._corrupt").isNull()).select(*[F.col(f"e.`{f.name}`") for f in schema.fields]), parsed.agg(F.count("e._corrupt").alias("corrupt"))


def append_events(events: DataFrame, folder: str, at: str) -> None:
    """Adds JSON lines under ``day=<yyyy-MM-dd>``, one file a task and day; rows without a time go to the null day."""
    events.withColumn("day", F.date_format(at, "yyyy-MM-dd")).repartition("day").write.mode("append").partitionBy("day").json(folder)


def read_fixed(spark: SparkSession, path: str, layout: str, fields: list[tuple[str, str]], encoding: str = "gbk") -> DataFrame:
    """Records of fixed width from binary files, as ``struct`` lays them out; text fields lose padding.

    A file that is no whole number of records fails the query. ``fields`` are
    (name, Spark type). Files are the unit of work and must fit a task.
    """
    width = struct.calcsize(layout)
    schema = ", ".join(["_path string", *(f"`{n}` {t}" for n, t in fields)])

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                if len(content) % width:
                    raise ValueError(f"{path_}: {len(content)} bytes are no whole number of records of {width}")
                rows = [tuple(v.split(b"\0")[0].decode(encoding, "replace").strip() if isinstance(v, bytes) else v for v in r) for r in struct.iter_unpack(layout, content)]
                out = pd.DataFrame(rows, columns=[n for n, _ in fields])
                out.insert(0, "_path", path_)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, schema)


def content_hash(rows: DataFrame, columns: list[str]) -> F.Column:
    """16 digits that change with any of the columns; null differs from empty."""
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256), 1, 16)


def increment(new: DataFrame, built: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reusable, pending): built rows whose key and content are unchanged, and new rows to build. ``built`` has key and hash16."""
    marked = new.withColumn("hash16", content_hash(new, columns))
    return built.join(marked.select(key, "hash16"), [key, "hash16"], "left_semi"), marked.join(built.select(key, "hash16"), [key, "hash16"], "left_anti")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, row: rows, as JSON, that one frame has more often than the other; empty if they are the same."""
    rows = lambda df: df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("row"))
    x, y = rows(a), rows(b)
    return x.exceptAll(y).select(F.lit("first").alias("side"), "row").unionByName(y.exceptAll(x).select(F.lit("second").alias("side"), "row"))


def search_runs(spark: SparkSession, folder: str, date: str | None = None, contains: str | None = None, code: str | None = None) -> DataFrame:
    """timestamp, query, codes of logged searches, torn lines left out: of a date, with a text in the query, with a code among the results."""
    schema = T.StructType().add("timestamp", "string").add("query", "string").add("codes", T.ArrayType(T.StringType()))
    rows, _ = read_events(spark, folder, schema)
    if date is not None:
        rows = rows.where(F.col("timestamp").startswith(date))
    if contains is not None:
        rows = rows.where(F.contains("query", F.lit(contains)))
    if code is not None:
        rows = rows.where(F.array_contains("codes", code))
    return rows
