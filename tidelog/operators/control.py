"""Checkpoints, frontiers, clean-up and retry schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_checkpoints(current: DataFrame, applied: DataFrame) -> DataFrame:
    """A device's checkpoint after what was applied, a row a segment: latest commit and change, highest segment, operations added.

    current: device_id, commit_id, change_number, segment_seq, txn_count; applied the same. A
    negative change number leaves the old one; a device without a checkpoint gets one.
    """
    rows = current.withColumn("_new", F.lit(0)).unionByName(applied.withColumn("_new", F.lit(1)))
    at = F.struct("_new", "segment_seq", "commit_id")
    return rows.groupBy("device_id").agg(
        F.max_by("commit_id", at).alias("commit_id"), F.coalesce(F.max_by("change_number", F.when(F.col("change_number") >= 0, at)), F.lit(-1)).alias("change_number"),
        F.max("segment_seq").alias("segment_seq"), F.sum("txn_count").alias("txn_count"),
    )


def latest_checkpoint(rows: DataFrame) -> DataFrame:
    """The row with the highest commit_id of each device."""
    return rows.groupBy("device_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "device_id"]), "commit_id").alias("c")).select("device_id", "c.*")


def cleanup_target(progress: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """device_id, target: one less than the lowest segment that all destinations have consolidated; missing counts as -1, and nothing is cleaned at 0 or less."""
    target = progress.groupBy("device_id").agg((F.min(F.coalesce("segment_seq", F.lit(-1))) - 1).alias("target"))
    return target.where("target > 0")


def cleaned_watermark(cleaned: DataFrame, first: int = 0) -> DataFrame:
    """device_id, watermark: the end of the unbroken run of cleaned segments from the first."""
    w = Window.partitionBy("device_id").orderBy("segment_seq")
    run = cleaned.select("device_id", "segment_seq").distinct().withColumn("_g", F.col("segment_seq") - F.row_number().over(w))
    return run.where(F.col("_g") == first - 1).groupBy("device_id").agg(F.max("segment_seq").alias("watermark"))


def shippable(segments: DataFrame) -> DataFrame:
    """Segments that may be shipped now: in number order, up to the first that isn't READY_TO_APPLY; missing numbers don't stop it."""
    blocked = segments.groupBy("device_id").agg(F.min(F.when(F.col("status") != "READY_TO_APPLY", F.col("segment_seq"))).alias("stop"))
    return segments.join(blocked, "device_id").where("stop is null or segment_seq < stop").drop("stop")


def unapplied(segments: DataFrame, applied: DataFrame) -> DataFrame:
    """Segments not yet marked as applied."""
    return segments.join(applied, ["device_id", "segment_seq"], "left_anti")


def backoff(attempt, initial_ms: int = 100, factor: float = 2.0, cap_ms: int = 30_000):
    """Milliseconds to wait after a failed attempt, counted from 1."""
    return F.least(F.lit(initial_ms) * F.pow(F.lit(factor), attempt - 1), F.lit(cap_ms)).cast("bigint")


def resume_point(log: DataFrame) -> DataFrame:
    """device_id, next_seq, last_commit: where a reopened device goes on."""
    return log.groupBy("device_id").agg((F.max("segment_seq") + 1).alias("next_seq"), F.max("commit_id").alias("last_commit"))


def properties_upsert(store: DataFrame, new: DataFrame, keys: list[str] = ("device_id", "name")) -> DataFrame:
    """A key-value store with new values in place of old ones."""
    return store.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def properties_delete(store: DataFrame, gone: DataFrame, keys: list[str] = ("device_id", "name")) -> DataFrame:
    return store.join(gone.select(*keys), list(keys), "left_anti")


def forget_device(store: DataFrame, device_ids: list[str]) -> DataFrame:
    """Metadata without these devices', for a reinitialisation; null ids stay."""
    return store.where(~F.coalesce(F.col("device_id").isin(device_ids), F.lit(False)))


def seed_checkpoint(log: DataFrame) -> DataFrame:
    """The first checkpoint of each device: its first commit, nothing applied."""
    return log.groupBy("device_id").agg(F.min("commit_id").alias("commit_id"), F.lit(-1).cast("bigint").alias("change_number"), F.lit(0).cast("bigint").alias("segment_seq"), F.lit(0).cast("bigint").alias("txn_count"))
