"""Algebra of ordered logs: carry-forward, transaction fates, sidecars, resumption, repair, rotation.

A log has device_id, segment_seq, change_number, commit_id and sql; its order within a device is
(segment_seq, change_number). Every operator partitions by device and segment at least, never
globally, and keeps further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.statements import is_control

SEGMENT = ["device_id", "segment_seq"]
COMMIT = [*SEGMENT, "commit_id"]
ORDER = ["segment_seq", "change_number"]


#: Bytes of files to a task where dealt() deals rows out.
TASK_BYTES = 8 << 20


def dealt(*sides: tuple[DataFrame, list[str]]) -> list[DataFrame]:
    """The sides of a join, each dealt by its keys to a task for every TASK_BYTES of the files they come from.

    Spark raises a smaller count to spark.sql.shuffle.partitions in the join, but merges none.
    Left to itself it merges partitions up to 64 MB as compressed; the rows of a log, much alike,
    take 20 times that and more in a task's sorts and aggregates. Sides that give every core too
    little for that, or of unknown size, stay as they are.
    """
    leaves = [x.apply(k) for df, _ in sides for x in [df._jdf.queryExecution().optimizedPlan().collectLeaves()] for k in range(x.size())]
    size = sum(int(str(x.stats().sizeInBytes())) for x in leaves)
    n = size // TASK_BYTES
    if n <= sides[0][0].sparkSession.sparkContext.defaultParallelism or size >= 1 << 60:  # what Spark can't tell is 2^63 - 1
        return [df for df, _ in sides]
    return [df.repartition(n, *keys) for df, keys in sides]


def _marker(sql: Column) -> Column:
    u = F.upper(F.regexp_replace(sql, r"^\s+", ""))
    return F.when(u.startswith("COMMIT"), "Commit").when(u.startswith("ROLLBACK"), "Rollback")


def carry_forward(log: DataFrame, changes: bool = False) -> DataFrame:
    """sql of a prepared batch's later rows, from the last row that has it.

    In a command log only null is missing, and rows before the first statement go; in a change log
    (changes) blank is missing too, and such rows stay with an empty text.
    """
    present = F.when(F.trim("sql") != "", F.col("sql")) if changes else F.col("sql")
    before = Window.partitionBy(*SEGMENT).orderBy("change_number").rowsBetween(Window.unboundedPreceding, 0)
    out = log.withColumn("sql", F.last(present, ignorenulls=True).over(before))
    return out.fillna({"sql": ""}) if changes else out.where("sql is not null")


def fates(log: DataFrame) -> DataFrame:
    """device_id, segment_seq, commit_id, fate: Commit, Rollback or Unknown; the last marker wins."""
    mark = _marker(F.col("sql"))
    last = F.max_by(mark, F.when(mark.isNotNull(), F.col("change_number")))
    return log.groupBy(*COMMIT).agg(F.coalesce(last, F.lit("Unknown")).alias("fate"))


def committed(log: DataFrame, parity: bool = False) -> DataFrame:
    """Rows of committed transactions, markers included; with parity all rows, as restricted devices ship them."""
    return log if parity else log.join(fates(log).where("fate = 'Commit'"), COMMIT, "left_semi")


def max_committed(log: DataFrame) -> DataFrame:
    """The highest committed commit_id of each segment, so that empty transactions advance a checkpoint too."""
    return fates(log).groupBy(*SEGMENT).agg(F.max(F.when(F.col("fate") == "Commit", F.col("commit_id"))).alias("max_commit_id"))


def expand_sidecars(log: DataFrame, sidecars: DataFrame) -> DataFrame:
    """REPLAY_TXN rows replaced by the rows of their sidecar, less its control statements.

    A sidecar's rows carry the outer commit_id and change_number, and ordinal orders them; other
    rows have ordinal 0. A row whose sidecar is missing fails the query.
    """
    replay = F.trim("sql") == "REPLAY_TXN"
    inner = sidecars.select(*COMMIT, F.col("change_number").alias("ordinal"), F.col("sql").alias("inner_sql"), *[c for c in sidecars.columns if c in ("args", "arg_types")])
    outer = log.where(replay).drop("sql", *[c for c in inner.columns if c in ("args", "arg_types")])
    outer, inner = dealt((outer, COMMIT), (inner, COMMIT))
    joined = outer.join(inner, COMMIT, "left")
    joined = joined.withColumn("sql", F.when(F.col("inner_sql").isNull(), F.raise_error(F.concat(F.lit("no sidecar for commit "), F.col("commit_id").cast("string")))).otherwise(F.col("inner_sql")))
    body = joined.where(~is_control(F.col("sql"))).drop("inner_sql")
    return log.where(~replay | F.col("sql").isNull()).withColumn("ordinal", F.lit(0).cast(inner.schema["ordinal"].dataType)).unionByName(body)


def decided_segments(log: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Segments whose last transaction has an exact COMMIT or ROLLBACK, or a sidecar that is there; others wait."""
    exact = F.trim("sql").isin("COMMIT", "ROLLBACK")
    by_commit = log.groupBy(*COMMIT).agg(F.max(exact.cast("int")).alias("exact"), F.max((F.trim("sql") == "REPLAY_TXN").cast("int")).alias("replay"))
    last = by_commit.groupBy(*SEGMENT).agg(F.max_by(F.struct("exact", "replay", "commit_id"), "commit_id").alias("l")).select(*SEGMENT, "l.*")
    if sidecars is None:
        return last.where("exact = 1").select(*SEGMENT)
    there = sidecars.select(*COMMIT).distinct().withColumn("there", F.lit(1))
    return last.join(there, COMMIT, "left").where("exact = 1 or replay = 1 and there = 1").select(*SEGMENT)

def until_undecided(log: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """The log of each device before its first segment whose last transaction is not decided: that one and all later ones wait."""
    open_ = log.select(*SEGMENT).distinct().join(decided_segments(log, sidecars), SEGMENT, "left_anti")
    stop = open_.groupBy("device_id").agg(F.min("segment_seq").alias("_stop"))
    return log.join(stop, "device_id", "left").where("_stop is null or segment_seq < _stop").select(*log.columns)



def skip_segments(log: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Rows of segments that a destination has not finished: checkpoint has device_id, resume_seq, resume_change."""
    last = log.groupBy(*SEGMENT).agg(F.max("change_number").alias("last_change"))
    done = last.join(checkpoint, "device_id").where("resume_seq > segment_seq or resume_seq = segment_seq and resume_change >= last_change")
    return log.join(done.select(*SEGMENT), SEGMENT, "left_anti")


def resume(log: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Within the segment resumed, rows after the checkpoint's change; a negative one resumes nothing."""
    kept = log.join(checkpoint.select("device_id", "resume_seq", "resume_change"), "device_id", "left")
    seen = (F.col("resume_change") >= 0) & (F.col("segment_seq") == F.col("resume_seq")) & (F.col("change_number") <= F.col("resume_change"))
    return kept.where(~F.coalesce(seen, F.lit(False))).drop("resume_seq", "resume_change")


def resume_replica(log: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """For a replica: drop earlier segments, and in its own segment commits up to the last replayed."""
    kept = log.join(checkpoint.select("device_id", "resume_seq", "resume_commit"), "device_id", "left")
    seen = (F.col("segment_seq") < F.col("resume_seq")) | (F.col("segment_seq") == F.col("resume_seq")) & (F.col("commit_id") <= F.col("resume_commit"))
    return kept.where(~F.coalesce(seen, F.lit(False))).drop("resume_seq", "resume_commit")


def images(changes: DataFrame) -> DataFrame:
    """before and after arrays from args: INSERT is all after, DELETE all before, UPDATE before then after."""
    half = F.floor(F.size("args") / 2).cast("int")
    return changes.withColumns({
        "before": F.when(F.col("op") == "DELETE", F.col("args")).when(F.col("op") == "UPDATE", F.slice("args", F.lit(1), half)),
        "after": F.when(F.col("op") == "INSERT", F.col("args")).when(F.col("op") == "UPDATE", F.slice("args", half + 1, half)),
    })


def apply_order(changes: DataFrame) -> DataFrame:
    """args of an UPDATE with its halves swapped, as an applying statement takes them: new values, then old."""
    half = F.floor(F.size("args") / 2).cast("int")
    return changes.withColumn("args", F.when(F.col("op") == "UPDATE", F.concat(F.slice("args", half + 1, half), F.slice("args", F.lit(1), half))).otherwise(F.col("args")))


def bad_widths(changes: DataFrame, widths: DataFrame) -> DataFrame:
    """Events whose images don't fit their table (table_name, width): the quarantine."""
    expected = F.when(F.col("op") == "UPDATE", 2 * F.col("width")).otherwise(F.col("width"))
    return changes.join(widths, "table_name", "left").where(F.col("width").isNull() | (F.size("args") != expected))


def resolve_in_doubt(sources: DataFrame, logs: DataFrame) -> DataFrame:
    """What restart must do for each device: source commit M (device_id, source_commit, device_type) against log commit L with its fate.

    append COMMIT, append ROLLBACK, remove commit, none, or error.
    """
    both = sources.join(logs, "device_id", "full_outer")
    m, l, fate = F.coalesce("source_commit", F.lit(0)), F.coalesce("log_commit", F.lit(0)), F.coalesce("fate", F.lit("Unknown"))
    undo = F.when(F.col("device_type") == "SQLITE", "append ROLLBACK").otherwise("remove commit")
    action = (
        F.when((m == 0) | (l == 0), "none").when(l < m, "error")
        .when(l > m, F.when(fate == "Commit", "error").when(fate == "Unknown", undo).otherwise("none"))
        .otherwise(F.when(fate == "Rollback", "error").when(fate == "Unknown", "append COMMIT").otherwise("none"))
    )
    return both.withColumn("action", action)


def in_doubt_action(source_commit: int, log_commit: int, fate: str, device_type: str) -> str:
    """resolve_in_doubt() for one device, as its restart needs it before any session is there; a log whose database never committed is undone too."""
    if not source_commit or not log_commit:
        return "none" if log_commit == 0 or fate != "Unknown" else "append ROLLBACK" if device_type == "SQLITE" else "remove commit"
    if log_commit < source_commit or log_commit > source_commit and fate == "Commit" or log_commit == source_commit and fate == "Rollback":
        return "error"
    if fate != "Unknown":
        return "none"
    return "append COMMIT" if log_commit == source_commit else "append ROLLBACK" if device_type == "SQLITE" else "remove commit"


def repair(log: DataFrame, actions: DataFrame) -> DataFrame:
    """The log after the actions of resolve_in_doubt(): markers appended, or an undone commit's rows removed."""
    todo = actions.select("device_id", F.col("log_commit").alias("commit_id"), "action").where("action <> 'none'")
    if todo.where("action = 'error'").head(1):
        raise RuntimeError("a log and its source disagree on a decided transaction")
    kept = log.join(todo.where("action = 'remove commit'"), ["device_id", "commit_id"], "left_anti").select(*log.columns)
    ends = log.join(todo.where("action like 'append%'"), ["device_id", "commit_id"]).groupBy("device_id", "commit_id", "action").agg(
        F.max("segment_seq").alias("segment_seq"), F.max_by("change_number", F.struct(*ORDER)).alias("last"))
    marks = ends.select("device_id", "segment_seq", (F.col("last") + 1).alias("change_number"), "commit_id", F.expr("substring(action, 8)").alias("sql"))
    return kept.unionByName(marks, allowMissingColumns=True)


def rotate(log: DataFrame, most: int = 1_000_000) -> DataFrame:
    """segment_seq and change_number assigned anew: a segment takes whole commits, and ends once ``most`` rows precede."""
    sizes = log.groupBy("device_id", "commit_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("device_id").orderBy("commit_id").rowsBetween(Window.unboundedPreceding, -1)
    seq = sizes.withColumn("segment_seq", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most)).drop("n")
    place = Window.partitionBy("device_id", "new_seq").orderBy("commit_id", *ORDER)
    out = log.join(seq.withColumnRenamed("segment_seq", "new_seq"), ["device_id", "commit_id"])
    return out.withColumn("change_number", F.row_number().over(place) - 1).withColumn("segment_seq", F.col("new_seq")).select(*log.columns)


def monotonic_commit_ids(events: DataFrame, clock_ms: str = "clock_ms", order: list[str] = ("ordinal",)) -> DataFrame:
    """commit_id: each the clock or one more than the last, whichever is greater, in order within a device."""
    w = Window.partitionBy("device_id").orderBy(*order)
    rn = F.row_number().over(w)
    lead = events.withColumn("_rn", rn).withColumn("_slack", F.col(clock_ms) - F.col("_rn"))
    return lead.withColumn("commit_id", F.max("_slack").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_rn")).drop("_rn", "_slack")


def operation_batches(log: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """batch_id and place: runs of consecutive rows with the same table and sql, cut at each kind's limit; DDL alone."""
    limits = {"INSERT": 1000, "UPDATE": 1000, "DELETE": 1000, **(limits or {})}
    w = Window.partitionBy(*SEGMENT).orderBy("change_number")
    key = F.struct("kind", "table_name", "sql")
    fresh = F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    runs = log.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*SEGMENT, "_run").orderBy("change_number")) - 1
    limit = F.coalesce(*(F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()), F.lit(1))
    return runs.withColumn("_n", place).withColumn("_cut", F.floor(F.col("_n") / limit)).withColumn("batch_id", F.dense_rank().over(w_batches())).withColumn("place", F.col("_n") % limit).drop("_run", "_n", "_cut")


def w_batches():
    return Window.partitionBy(*SEGMENT).orderBy("_run", "_cut")
