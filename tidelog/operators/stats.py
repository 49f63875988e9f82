"""Counts, totals, lags and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.statements import new_table_name, operation, table_name

# The counters of table statistics, by operation.
COUNTERS = {
    "INSERT": "insert_rows", "UPDATE": "update_rows", "DELETE": "delete_rows", "CREATETABLE": "create_table", "DROPTABLE": "drop_table",
    "ADDCOLUMN": "add_column", "DROPCOLUMN": "drop_column", "RENAMECOLUMN": "rename_column", "RENAMETABLE": "rename_table",
}


def table_statistics(log: DataFrame, consolidation: bool = True, by: list[str] = ()) -> DataFrame:
    """Statements of each kind by table, of a log carried forward; statements count, whatever became of their transaction.

    A consolidated table is never dropped from: drops don't count, a renamed column is an added
    one, a renamed table a created one of the new name.
    """
    o, t = F.col("_op"), F.col("_table")
    # step by step, so that no label is worked out more than once
    rows = log.withColumn("_op", operation(F.col("sql"))).where(o.isin(*COUNTERS)).withColumn("_table", table_name(F.col("sql")))
    if consolidation:
        rows = rows.where(~o.isin("DROPTABLE", "DROPCOLUMN"))
        rows = rows.withColumn("_table", F.when(o == "RENAMETABLE", new_table_name(F.col("sql"))).otherwise(t))
        rows = rows.withColumn("_op", F.when(o == "RENAMETABLE", "CREATETABLE").when(o == "RENAMECOLUMN", "ADDCOLUMN").otherwise(o))
    rows = rows.select(*by, F.lower(F.substring_index(t, ".", -1)).alias("table_name"), "_op").where("table_name is not null")
    return rows.groupBy(*by, "table_name").agg(*(F.count_if(F.col("_op") == o).alias(c) for o, c in COUNTERS.items()))


def device_statistics(segments: DataFrame) -> DataFrame:
    """operations, transactions (one a segment that applied anything), bytes by device, from rows of device_id, segment_seq, operations, bytes."""
    return segments.groupBy("device_id").agg(F.sum("operations").alias("operations"), F.count_if(F.col("operations") > 0).alias("transactions"), F.sum("bytes").alias("bytes"))


def dashboard(segments: DataFrame) -> DataFrame:
    """Running totals over a device's segments."""
    w = Window.partitionBy("device_id").orderBy("segment_seq").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumns({"total_operations": F.sum("operations").over(w), "total_bytes": F.sum("bytes").over(w), "total_segments": F.count("*").over(w)})


def device_status(events: DataFrame) -> DataFrame:
    """The latest status of each device, by ts."""
    return events.groupBy("device_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "device_id"]), "ts").alias("s")).select("device_id", "s.*")


def segment_latency(segments: DataFrame, now_ms) -> DataFrame:
    return segments.withColumn("latency_ms", F.greatest(F.lit(0), now_ms - F.col("written_ms")))


def sync_latency(sources: DataFrame, applied: DataFrame) -> DataFrame:
    """latency_ms: source commit less applied commit, never negative; -1 where either is unknown."""
    both = sources.join(applied, "device_id", "left")
    known = F.col("source_commit").isNotNull() & F.col("applied_commit").isNotNull()
    return both.withColumn("latency_ms", F.when(known, F.greatest(F.col("source_commit") - F.col("applied_commit"), F.lit(0))).otherwise(F.lit(-1)))


def sync_state(devices: DataFrame) -> DataFrame:
    """state: NotInitialized without a checkpoint, Paused, else Running."""
    return devices.withColumn("state", F.when(F.col("applied_commit").isNull(), "NotInitialized").when(F.col("paused"), "Paused").otherwise("Running"))


GAUGES = ("devices", "segments_applied", "operations_applied", "bytes_applied", "max_latency_ms")


def gauges(segments: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row of gauges for a metrics sink."""
    a = segments.agg(F.count_distinct("device_id").alias("devices"), F.count("*").alias("segments_applied"), F.sum("operations").alias("operations_applied"), F.sum("bytes").alias("bytes_applied"))
    return a.crossJoin(latencies.agg(F.max("latency_ms").alias("max_latency_ms")))


def exposition(row, prefix: str = "tidelog_") -> str:
    """A row of gauges in the text format that metrics servers read."""
    return "".join(f"# TYPE {prefix}{k} gauge\n{prefix}{k} {row[k] or 0}\n" for k in GAUGES)
