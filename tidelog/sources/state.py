"""Versioned tables on plain Parquet: a folder for each batch, and a list of folders swapped when it is complete."""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bucket of tables that are written whole.
WHOLE = -1


class VersionedTable:
    """A table's state after each batch. A batch that is written twice counts once.

    Batches are numbered within a run, a stream's checkpoint: a new checkpoint counts anew. A table
    may be parted into buckets by key, of which a batch rewrites those alone that it touches. All
    file access goes through Hadoop's file systems, so any store that Spark reaches will do.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        try:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/current"))]
        except Py4JJavaError:
            return []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        """The last complete batch's version."""
        return max(self._versions(), default=None)

    def _list(self, version: int | None) -> dict:
        """A version's folders by bucket, and the last batch of each run."""
        if version is None:
            return {"folders": {}, "runs": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/current/{version}", wholetext=True).collect()))

    def applied(self, batch: int, run: str = "") -> bool:
        return self._list(self.version())["runs"].get(run, -1) >= batch

    def _read(self, folders: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.path}/{f}" for f in sorted(set(folders.values()))]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        return self._read(self._list(self.version())["folders"])

    def _commit(self, version: int, folders: dict, runs: dict) -> None:
        # what is renamed last is the commit: readers list the folder
        at = self._path(f"{self.path}/current/.{version}.tmp")
        out = self._fs.create(at, True)
        out.write(bytearray(json.dumps({"folders": folders, "runs": runs}).encode()))
        out.close()
        self._fs.rename(at, self._path(f"{self.path}/current/{version}"))

    def write(self, rows: DataFrame, batch: int, run: str = "") -> bool:
        """Write a batch's whole state; False if the run's batch, or a later one, is there already."""
        now, runs = self.version(), self._list(self.version())["runs"]
        if runs.get(run, -1) >= batch:
            return False
        version = max(batch, -1 if now is None else now) + (now is not None and now >= batch)
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self._commit(version, {str(WHOLE): f"v={version}"}, {**runs, run: batch})
        return True

    def update(self, changes: DataFrame, keys: list[str], fold: Callable[[DataFrame, DataFrame | None], DataFrame], batch: int, run: str = "") -> bool:
        """Fold changes into the buckets that hold their keys; the others stay as they are. fold must keep a row of every key."""
        now = self.version()
        known = self._list(now)
        if known["runs"].get(run, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        touched = [r.b for r in changes.select(bucket.alias("b")).distinct().collect()]
        version = 0 if now is None else now + 1
        folders = dict(known["folders"])
        state = self._read({b: f for b, f in folders.items() if int(b) in touched or int(b) == WHOLE})
        if touched:
            name = "_bucket"
            # a folder a bucket, its rows in it without the bucket's number
            fold(changes, state).withColumn(name, bucket).repartition(name).write.mode("overwrite").partitionBy(name).parquet(f"{self.path}/v={version}")
            if str(WHOLE) in folders:  # written whole before: all buckets are new
                folders, touched = {}, range(self.buckets)
            there = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/v={version}"))}
            folders |= {str(b): f"v={version}/{name}={b}" for b in touched if f"{name}={b}" in there}
        self._commit(version, folders, {**known["runs"], run: batch})
        return True

    def prune(self, keep: int = 2) -> None:
        """Drop all but the last versions, and folders that none of them uses."""
        versions = self._versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/current/{v}"), False)
        used = {f for v in versions[-keep:] for f in self._list(v)["folders"].values()}
        for s in self._fs.listStatus(self._path(self.path)) if versions else ():
            top = s.getPath().getName()
            if not top.startswith("v=") or top in used or int(top[2:]) > versions[-1]:
                continue
            parts = [p.getPath() for p in self._fs.listStatus(s.getPath()) if f"{top}/{p.getPath().getName()}" in used]
            if not parts:
                self._fs.delete(s.getPath(), True)
                continue
            for p in self._fs.listStatus(s.getPath()):
                name = p.getPath().getName()
                if "=" in name and f"{top}/{name}" not in used:
                    self._fs.delete(p.getPath(), True)
