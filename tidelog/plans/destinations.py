"""What surrounds a destination: preparing its tables, triggers, connections, retries, validation, catalog snapshots, control files."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.rules import INIT_MODES, parse_properties
from tidelog.plans.registry import Registry

T = TypeVar("T")


def prepare(spark: SparkSession, state: DataFrame | None, schema: str, mode: str = "TRY_CREATE_APPEND_DATA", device_id: str | None = None) -> DataFrame:
    """A table as an initialisation mode leaves it: created if missing and the mode creates, emptied if it empties.

    With a device_id only that device's rows go, as others share a consolidated table.
    """
    create, empty = INIT_MODES[mode]
    if state is None:
        if not create:
            raise ValueError(f"{mode} needs a table that is there")
        return spark.createDataFrame([], schema)
    if not empty:
        return state
    return state.where(~F.col("src_device_id").eqNullSafe(device_id)) if device_id else state.limit(0)


@dataclass(frozen=True)
class Triggers:
    """Statements run on temporary views of the tables after a batch that touched them."""

    statements: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Triggers:
        return cls({k.upper(): [v] if isinstance(v, str) else list(v) for k, v in json.loads(text).items()})

    def run(self, tables: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
        """Each touched table's statements, once; what they select, by table."""
        for name, rows in tables.items():
            rows.createOrReplaceTempView(name)
        return {n: [rows.sparkSession.sql(s) for s in self.statements.get(n.upper(), ())] for n, rows in tables.items() if n.upper() in self.statements}


def connection(text: str, kind: str) -> dict[str, str]:
    """Options of a JDBC connection, or the path of an embedded database, from a jdbc: string or a bare one."""
    bare = re.sub(r"^jdbc:", "", text.strip())
    if kind in ("sqlite", "duckdb"):
        path = re.sub(rf"^{kind}:", "", bare).split("?")[0]
        if not path:
            raise ValueError(f"no path in {text!r}")
        return {"path": path}
    m = re.match(r"(?:postgresql|postgres):(?://)?(?:([^:@/]+)(?::([^@/]*))?@)?([^/?]*)/([^?]*)(?:\?(.*))?$", bare)
    if not m:
        raise ValueError(f"not a connection: {text!r}")
    asked = dict(p.split("=", 1) for p in (m[5] or "").split("&") if "=" in p)
    out = {"url": f"jdbc:postgresql://{m[3] or 'localhost'}/{m[4]}", "user": m[1] or asked.pop("user", ""), "password": m[2] or asked.pop("password", "")}
    return {**{k: v for k, v in out.items() if v}, **asked}


def write_jdbc(rows: DataFrame, table: str, options: dict[str, str], batch: int = 1000) -> None:
    """Append to a server's table, in batches of one transaction a partition."""
    rows.write.format("jdbc").options(**options).option("dbtable", table).option("batchsize", batch).mode("append").save()


def retry(work: Callable[[], T], attempts: int = 3, wait_ms: int = 1000, may_pass: Callable[[str], bool] = lambda message: True) -> T:
    """work(), again after a wait if it fails with an error that may pass."""
    for k in range(1, attempts + 1):
        try:
            return work()
        except Exception as e:
            if k == attempts or not may_pass(str(e)):
                raise
            time.sleep(wait_ms / 1000)
    raise AssertionError("no attempts")


def analyses(spark: SparkSession, query: str, registry: Registry) -> str | None:
    """None if a query can be planned against empty tables of a registry's schemas, else why not."""
    for name in registry.tables:
        spark.createDataFrame([], registry.schema(name)).createOrReplaceTempView(name)
    try:
        spark.sql(query).schema  # noqa: B018  forces analysis
        return None
    except PySparkException as e:
        return str(e).splitlines()[0]
    finally:
        for name in registry.tables:
            spark.catalog.dropTempView(name)


def catalog_snapshot(spark: SparkSession, device_id: str, registry: Registry) -> DataFrame:
    """device_id, table_name, create_sql, schema_json: from which the registry of the source can be rebuilt."""
    rows = []
    for name, columns in sorted(registry.tables.items()):
        keys = registry.keys(name)
        parts = [f"{c.name} {c.type}".strip() for c in columns] + ([f"PRIMARY KEY({', '.join(keys)})"] if keys else [])
        rows.append((device_id, name, f"CREATE TABLE {name}({', '.join(parts)})", spark.createDataFrame([], registry.schema(name)).schema.json()))
    return spark.createDataFrame(rows, "device_id string, table_name string, create_sql string, schema_json string")


def rebuild(snapshot: DataFrame, consolidated: bool = False) -> dict[str, Registry]:
    """The registries that catalog_snapshot() saved, by device."""
    out: dict[str, Registry] = {}
    for r in snapshot.orderBy("device_id", "table_name").toLocalIterator():
        out.setdefault(r.device_id, Registry(consolidated)).apply(r.create_sql)
    return out


def initial_statistics(tables: dict[str, DataFrame], device_id: str) -> DataFrame:
    """device_id, table_name, initial_rows of a snapshot's tables."""
    parts = [rows.agg(F.count("*").alias("initial_rows")).select(F.lit(device_id).alias("device_id"), F.lit(t).alias("table_name"), "initial_rows") for t, rows in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CONTROL_FILES = ("reinitialize", "pause_sync", "resume_sync")


def take_control_files(folder: str, device: str) -> list[str]:
    """Actions that files <action>.<device> ask for; the files go, and resuming wins over pausing."""
    found = []
    for action in CONTROL_FILES:
        path = os.path.join(folder, f"{action}.{device}")
        if os.path.exists(path):
            os.remove(path)
            found.append(action)
    return [a for a in found if not (a == "pause_sync" and "resume_sync" in found)]


def indexed_settings(text: str) -> dict[int, dict[str, str]]:
    """Settings by destination from key-<n> properties; keys without a number are destination 1's, whose own win."""
    out: dict[int, dict[str, str]] = {}
    plain: dict[str, str] = {}
    for key, value in parse_properties(text).items():
        if m := re.fullmatch(r"(.+?)-(\d+)", key):
            out.setdefault(int(m[2]), {})[m[1]] = value
        else:
            plain[key] = value
    if plain:
        out[1] = {**plain, **out.get(1, {})}
    return out
