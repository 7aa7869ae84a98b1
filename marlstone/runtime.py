"""Session, staging and join helpers shared by every operator.

Lineage is cut only through the shared folder the cluster names in
``spark.checkpoint.dir``; a folder of our own is used in local mode alone.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; every caller has narrow rows (< 200 bytes), so this bounds a broadcast to ~20 MB.
BROADCAST_ROWS = 100_000
#: Keys at most that a join handles apart for being frequent, and from how many rows on.
HOT_KEYS, HOT_ROWS = 1_000, 1_000_000


def local_session(cores: str | int = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marlstone")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder stands in, in local mode only; on a
    cluster that is an error, as a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="marlstone-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_STAGED: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted by ``release``."""
    _STAGED.append(os.path.join(shared_dir(spark), "staged", f"{name}-{uuid.uuid4().hex}"))
    return _STAGED[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as parquet and read back.

    Unlike a cached frame it survives lost executors; unlike a reliable
    checkpoint it is columnar and compressed and keeps column pruning.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what this process has staged and returns how much that was; call it once the results are written."""
    jvm, n = spark.sparkContext._jvm, len(_STAGED)
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few to keep them busy with costly functions; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no more than that plus one."""
    return df.limit(bound + 1).count() <= bound


def join_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    bound: int = BROADCAST_ROWS,
    hot_rows: int | None = HOT_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Join a large, possibly skewed side with a lookup that is unique by ``on``.

    Up to ``bound`` rows the lookup is broadcast. Beyond, the keys that hold more
    than ``hot_rows`` rows of ``facts``, null among them, are found by a count
    and joined apart: of the commonest ``HOT_KEYS`` the lookup's rows are
    broadcast. All else is shuffled, and no key left there holds more than
    ``hot_rows`` rows or a thousandth of all. Null keys match nothing. Where ``facts``
    is known to have no frequent keys, ``hot_rows`` None saves the count.
    """
    if fits is None:
        fits = within(lookup, bound)
    if fits:
        return facts.join(F.broadcast(lookup), on, how)
    if hot_rows is None:
        return facts.join(lookup, on, how)
    often = facts.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = staged(often.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*[F.col(c).alias(f"_hot_{c}") for c in on]), "hot")
    if not hot.limit(1).count():
        return facts.join(lookup, on, how)

    def apart(df: DataFrame, kind: str) -> DataFrame:
        same = reduce(lambda x, y: x & y, [df[c].eqNullSafe(hot[f"_hot_{c}"]) for c in on])
        return df.join(F.broadcast(hot), same, kind)

    few = apart(facts, "left_semi").join(F.broadcast(apart(lookup, "left_semi")), on, how)
    return few.unionByName(apart(facts, "left_anti").join(lookup, on, how))


def js_round(value: Column, digits: int = 0) -> Column:
    """``floor(v * 10^d + 0.5) / 10^d``: halves go up, for negatives as well."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / F.lit(scale)


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python objects, which Arrow takes in one piece, empty frames too."""
    text = [c for c, t in rows.dtypes.items() if pd.api.types.is_string_dtype(t) or t == object]
    return rows.astype(dict.fromkeys(text, object))
