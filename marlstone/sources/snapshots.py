"""Immutable snapshots: digest, manifest, an atomically swapped pointer, retention with references."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame) -> str:
    """A digest that doesn't depend on row order or partitioning: count, and sum and XOR of row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}))
    r = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x")).first()
    return f"{r['n']}:{r['s']}:{r['x']}"


class Store:
    """Snapshots under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _write(self, name: str, value: dict) -> None:
        """Written beside its place and renamed into it, so a reader sees the old or the new."""
        tmp, to = self._path(f"{self.root}/.{name}.tmp"), self._path(f"{self.root}/{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._fs.getConf())
        modes = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        modes[0] = self._rename.OVERWRITE
        files.rename(tmp, to, modes)

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0])

    def publish(self, rows: DataFrame, snapshot: str, partition: list[str] | None = None, refers: list[str] = ()) -> dict:
        """Writes a snapshot and its manifest; the pointer moves only after both. An existing snapshot is never overwritten."""
        path = f"{self.root}/data-{snapshot}"
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition) if partition else writer).parquet(path)
        manifest = {"snapshot": snapshot, "digest": digest(self.spark.read.parquet(path)), "columns": sorted(rows.columns), "refers": list(refers)}
        self._write(f"manifest-{snapshot}.json", manifest)
        self._write("current.json", {"snapshot": snapshot})
        return manifest

    def load(self, snapshot: str | None = None, verify: bool = False) -> DataFrame:
        """The current snapshot, or the one named; with ``verify`` its digest must be the manifest's."""
        snapshot = snapshot or (self._read("current.json") or {}).get("snapshot")
        if snapshot is None:
            raise LookupError("nothing is published")
        rows = self.spark.read.parquet(f"{self.root}/data-{snapshot}")
        if verify and digest(rows) != self._read(f"manifest-{snapshot}.json")["digest"]:
            raise ValueError(f"snapshot {snapshot} isn't what was published")
        return rows

    def snapshots(self) -> list[str]:
        return sorted(s.getPath().getName()[9:-5] for s in self._fs.listStatus(self._path(self.root)) if s.getPath().getName().startswith("manifest-"))

    def prune(self, keep_last: int, leased: set[str] = frozenset(), apply: bool = False) -> list[str]:
        """Snapshots that nothing needs: not among the last, current, leased, or referred to by one that stays, through any number of steps."""
        names = self.snapshots()
        keep = set(names[-keep_last:] if keep_last else []) | (leased & set(names)) | {(self._read("current.json") or {}).get("snapshot")}
        open_ = list(keep & set(names))
        while open_:
            for other in self._read(f"manifest-{open_.pop()}.json")["refers"]:
                if other in names and other not in keep:
                    keep.add(other)
                    open_.append(other)
        drop = [n for n in names if n not in keep]
        if apply:
            for n in drop:
                self._fs.delete(self._path(f"{self.root}/data-{n}"), True)
                self._fs.delete(self._path(f"{self.root}/manifest-{n}.json"), False)
        return drop
