"""The event analytics as Structured Streaming: daily windows, chains of a user, publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1000) -> DataFrame:
    """Parquet files as they arrive, at most ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def daily_counts(events: DataFrame, at: str, kind: str, late: str = "2 days", event: str | None = None) -> DataFrame:
    """day, kind, n over tumbling UTC days; events later than ``late`` are dropped, and repeats of ``event`` within that time."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    if event is not None:
        rows = rows.dropDuplicatesWithinWatermark([event])
    days = rows.groupBy(F.window("_at", "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n")


CHAIN = "user_id long, event_id long, group_id string, previous_id long, gap double"


def chains(events: DataFrame, gap_seconds: float = 120.0, late: str = "1 hour") -> DataFrame:
    """The chains of ``reformulations`` on a stream of user_id, event_id, ts: the same links, the state being each user's last event.

    Within a trigger a user's events are ordered by (time, id). The state of a
    user idle beyond the watermark and the gap is dropped: one small row a user,
    however many events there are.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for event, ts in zip(rows["event_id"].tolist(), rows["ts"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
            if last is not None and (ts - last[1]) / 1e6 <= gap_seconds:
                group = last[2] or f"rg_{last[0]}"
                out.append((key[0], event, group, last[0], (ts - last[1]) / 1e6))
                last = (event, ts, group)
            else:
                out.append((key[0], event, None, None, None))
                last = (event, ts, None)
        state.update(last)
        state.setTimeoutTimestamp(max(last[1] // 1000 + int(gap_seconds * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "group_id", "previous_id", "gap"]).astype({"previous_id": "Int64"})

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where(F.col("user_id").isNotNull()).withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, CHAIN, "event long, at long, group string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there, exactly once by checkpoint, batch by batch through ``sink``, and stops."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def overwrite_days(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that replaces the days a batch has and leaves others, so a repeated batch changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)

    return sink
