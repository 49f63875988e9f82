"""The batch plans as incremental ones: micro-batches of log segments, folded into versioned state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import log as L
from tidelog.operators.apply import keyed_merge, live
from tidelog.sources.state import VersionedTable


class Consolidation:
    """A stream of changes folded into one table by key, exactly once for each batch.

    source is a folder of Parquet (device_id/segment_seq partitions or not) that grows by whole
    segments; the query's checkpoint remembers what has been read, the table which of its batches
    have been applied. Transactions never straddle a segment, so a batch can tell committed rows by
    itself. The state keeps the order of each key's latest change, and of deletes: segments may come
    late, and a stream that begins anew on a fresh checkpoint finds the same rows again.
    """

    def __init__(self, spark: SparkSession, source: str, schema: str, keys: list[str], table: str, checkpoint: str,
                 triggers: list[Callable[[DataFrame], None]] = (), parity: bool = False, files_per_batch: int | None = None):
        self.spark, self.source, self.schema, self.keys, self.checkpoint = spark, source, schema, ["device_id", *keys], checkpoint
        self.table, self.triggers, self.parity, self.files = VersionedTable(spark, table), triggers, parity, files_per_batch
        self.query: StreamingQuery | None = None

    def _run(self) -> str:
        """What tells this checkpoint from a later one in the same place."""
        path = self.table._path(f"{self.checkpoint}/tidelog-run")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, False)
            out.write(bytearray(uuid.uuid4().hex.encode()))
            out.close()
        return self.spark.read.text(path.toString()).first().value

    def _apply(self, batch: DataFrame, batch_id: int) -> None:
        good = L.committed(batch, self.parity).where("op is not null").drop("sql", "commit_id", "op")
        if self.table.update(good, self.keys, lambda changes, state: keyed_merge(changes, self.keys, state), batch_id, self._run()):
            for t in self.triggers:
                t(self.read())
            self.table.prune()

    def read(self) -> DataFrame | None:
        """The live rows."""
        state = self.table.read()
        return None if state is None else live(state)

    def start(self, available_now: bool = True, interval: str = "2 seconds") -> StreamingQuery:
        reader = self.spark.readStream.schema(self.schema)
        if self.files:
            reader = reader.option("maxFilesPerTrigger", self.files)
        stream = reader.parquet(self.source)
        writer = stream.writeStream.foreachBatch(self._apply).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
        return self.query

    def drain(self) -> DataFrame | None:
        """Apply all that is there, then return the table."""
        self.start().awaitTermination()
        return self.read()

    def pause(self) -> None:
        """Stop; the checkpoint keeps the place, and start() goes on from it."""
        if self.query is not None and self.query.isActive:
            self.query.stop()


def append_only(spark: SparkSession, source: str, schema: str) -> DataFrame:
    """A streaming device's inserts as an unbounded table; its updates and deletes never enter the log."""
    return spark.readStream.schema(schema).parquet(source).where(F.col("op") == "INSERT")
