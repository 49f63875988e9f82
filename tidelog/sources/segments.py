"""Log segments: files <seq>.sqllog and <seq>.cdclog of devices, read and written.

A segment is an SQLite file with a table of rows and one of metadata, whose status says whether it
may be read. ``SegmentSource`` reads them as a Spark data source, a partition a file; Spark's own
formats serve for logs kept as Parquet or JSON.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.functions.session import ship_package

# A segment's states, its name, and the argument columns it begins with.
NEW, READY, APPLIED = "NEW", "READY_TO_APPLY", "APPLIED"
NAME = re.compile(r"^(\d+)\.(sqllog|cdclog)$")
ARGUMENTS = 16
SCHEMA = "device_id string, segment_seq bigint, status string, change_number bigint, commit_id bigint, op string, table_name string, sql string, arg_cnt int, args array<string>, arg_types array<string>"


def segment_seq(path: Column) -> Column:
    """The number in a segment's path, null for other files."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)(\d+)\.(?:sqllog|cdclog)$", 1), F.lit("")).try_cast("bigint")


def discover(top: str) -> list[tuple[str, str, int, str]]:
    """(device, path, seq, kind) of all segments below a folder, in numeric order; sidecars and other files are left out."""
    found = []
    for folder, _, names in os.walk(top):
        for n in names:
            if m := NAME.match(n):
                found.append((os.path.relpath(folder, top), os.path.join(folder, n), int(m[1]), m[2]))
    return sorted(found, key=lambda x: (x[0], x[2], x[3]))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def status(path: str) -> str | None:
    with _open(path) as c:
        row = c.execute("select value from metadata where key = 'status'").fetchone()
    return row[0] if row else None


def _text(value) -> str | None:
    return None if value is None else value.hex().upper() if isinstance(value, bytes) else str(value)


def _type(value) -> str:
    """An argument's storage class; its text alone doesn't tell a blob's hex from letters."""
    return {type(None): "null", int: "integer", float: "real", bytes: "blob"}.get(type(value), "text")


def argument(text: str | None, kind: str):
    """An argument from its text and storage class."""
    if text is None or kind == "null":
        return None
    return {"integer": int, "real": float, "blob": bytes.fromhex}.get(kind, str)(text)


def arguments(row) -> list:
    """The arguments of a row read from a segment, as they were logged."""
    return [argument(a, k) for a, k in zip(row.args or [], row.arg_types or [])]


def last_transaction(path: str) -> tuple[int, str]:
    """The last commit id of a segment, 0 if it has none, and its fate."""
    with _open(path) as c:
        table = "cdclog" if path.endswith(".cdclog") else "commandlog"
        rows = c.execute(f"select commit_id, sql from {table} order by change_number desc limit 1").fetchall()
    if not rows:
        return 0, "Unknown"
    word = (rows[0][1] or "").strip().rstrip(";").upper()
    return rows[0][0], {"COMMIT": "Commit", "ROLLBACK": "Rollback"}.get(word, "Unknown")


def read_segment(device: str, path: str) -> Iterator[tuple]:
    """Rows of a segment in change order, of whichever kind its tables say it is."""
    state = status(path)
    with _open(path) as c:
        tables = {r[0] for r in c.execute("select name from sqlite_master where type = 'table'")}
        table = next((t for t in ("commandlog", "cdclog") if t in tables), None)
        if table is None:
            raise ValueError(f"no log in {path}")
        columns = [r[1] for r in c.execute(f"pragma table_info({table})")]
        arguments = sorted((n for n in columns if re.fullmatch(r"arg\d+", n)), key=lambda n: int(n[3:]))
        own = "op_type, table_name" if table == "cdclog" else "null, null"
        seq = int(NAME.match(os.path.basename(path))[1])
        for r in c.execute(f"select change_number, commit_id, {own}, sql, arg_cnt{''.join(', ' + a for a in arguments)} from {table} order by change_number"):
            n = r[5] or 0
            yield (device, seq, state, r[0], r[1], r[2], r[3], r[4], n, [_text(v) for v in r[6 : 6 + n]], [_type(v) for v in r[6 : 6 + n]])


class _File(InputPartition):
    def __init__(self, device: str, path: str):
        self.device, self.path = device, path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.top, self.ready = options["path"], options.get("ready", "true").lower() == "true"
        self.after = json.loads(options.get("after", "{}"))

    def partitions(self):
        return [_File(d, p) for d, p, seq, _ in discover(self.top) if seq >= self.after.get(d, 0) and (not self.ready or status(p) in (READY, APPLIED))]

    def read(self, partition: _File):
        return read_segment(partition.device, partition.path) if partition else iter(())


class SegmentSource(DataSource):
    """spark.read.format("tidelog_segments").option("path", ...): ready (only finished segments, default true), after (JSON: device to first number)."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_segments(spark: SparkSession, top: str, after: dict[str, int] | None = None, ready: bool = True) -> DataFrame:
    """Rows of all segments below a folder that every executor sees."""
    ship_package(spark)
    spark.dataSource.register(SegmentSource)
    return spark.read.format("tidelog_segments").option("path", top).option("after", json.dumps(after or {})).option("ready", str(ready)).load()


class SegmentWriter:
    """Writes one segment; argument columns are added as statements need them. Nothing can be appended once it is finished."""

    def __init__(self, folder: str, seq: int, kind: str = "sqllog"):
        Path(folder).mkdir(parents=True, exist_ok=True)
        self.path, self.kind, self.next, self.width = os.path.join(folder, f"{seq}.{kind}"), kind, 0, ARGUMENTS
        if os.path.exists(self.path):
            raise FileExistsError(self.path)
        self.connection = sqlite3.connect(self.path)
        own = "database_name text, schema_name text, table_name text, op_type text, " if kind == "cdclog" else ""
        arguments = ", ".join(f"arg{k}" for k in range(1, self.width + 1))
        self.table = "cdclog" if kind == "cdclog" else "commandlog"
        self.connection.executescript(f"create table {self.table}(change_number integer primary key, commit_id integer, {own}sql text, arg_cnt integer, {arguments}); create table metadata(key text primary key, value text); insert into metadata values('status', '{NEW}');")

    @classmethod
    def reopen(cls, path: str) -> SegmentWriter:
        """Go on with a segment that was not finished."""
        out = cls.__new__(cls)
        out.path, out.kind = path, path.rsplit(".", 1)[1]
        out.table = "cdclog" if out.kind == "cdclog" else "commandlog"
        if status(path) != NEW:
            raise ValueError(f"{path} is finished")
        out.connection = sqlite3.connect(path)
        out.next = out.connection.execute(f"select coalesce(max(change_number) + 1, 0) from {out.table}").fetchone()[0]
        out.width = sum(bool(re.fullmatch(r"arg\d+", r[1])) for r in out.connection.execute(f"pragma table_info({out.table})"))
        return out

    def remove(self, commit_id: int) -> None:
        """Take back a commit's rows, the last ones."""
        self.connection.execute(f"delete from {self.table} where commit_id = ?", [commit_id])
        self.next = self.connection.execute(f"select coalesce(max(change_number) + 1, 0) from {self.table}").fetchone()[0]

    def append(self, commit_id: int, sql: str | None, args: list = (), op: str | None = None, table: str | None = None) -> int:
        if self.connection is None:
            raise ValueError(f"{self.path} is finished")
        for k in range(self.width + 1, len(args) + 1):
            self.connection.execute(f"alter table {self.table} add column arg{k}")
            self.width = k
        names = ["change_number", "commit_id", "sql", "arg_cnt", *(f"arg{k}" for k in range(1, len(args) + 1))]
        values = [self.next, commit_id, sql, len(args), *args]
        if self.kind == "cdclog":
            names, values = [*names, "op_type", "table_name"], [*values, op, table]
        self.connection.execute(f"insert into {self.table}({', '.join(names)}) values({', '.join('?' * len(names))})", values)
        self.next += 1
        return self.next - 1

    def flush(self) -> None:
        self.connection.commit()

    def finish(self) -> str:
        """Mark it ready to be applied."""
        if self.connection is not None:
            self.connection.execute("update metadata set value = ? where key = 'status'", [READY])
            self.connection.commit()
            self.connection.close()
            self.connection = None
        return self.path


def mark_applied(path: str) -> None:
    with sqlite3.connect(path) as c:
        c.execute("update metadata set value = ? where key = 'status'", [APPLIED])


def ship(path: str, archive: str) -> str:
    """Copy a finished segment into an archive folder: under another name first, so that no reader meets half a file."""
    os.makedirs(archive, exist_ok=True)
    target = os.path.join(archive, os.path.basename(path))
    if not os.path.exists(target) or status(target) != APPLIED:
        shutil.copyfile(path, target + ".tmp")
        os.replace(target + ".tmp", target)
    return target


def write_log(log: DataFrame, path: str) -> None:
    """A log as Parquet, a folder for each device and segment, so that resumption prunes folders."""
    log.repartition("device_id", "segment_seq").sortWithinPartitions("device_id", "segment_seq", "change_number").write.mode("append").partitionBy("device_id", "segment_seq").parquet(path)


def snapshot(tables: dict[str, DataFrame], device_id: str, include: list[str] = (), exclude: list[str] = ()) -> dict[str, DataFrame]:
    """A source's present tables as INSERT changes of segment -1, before any of its log."""
    from tidelog.functions.rules import selected_tables

    return {t: tables[t].select(F.lit(device_id).alias("device_id"), F.lit(-1).cast("bigint").alias("segment_seq"), F.lit(-1).cast("bigint").alias("change_number"),
                                F.lit(t).alias("table_name"), F.lit("INSERT").alias("op"), F.lit(None).cast(_struct(tables[t])).alias("before"), F.struct("*").alias("after"))
            for t in selected_tables(list(tables), include, exclude)}


def _struct(rows: DataFrame):
    return rows.select(F.struct("*").alias("r")).schema["r"].dataType
