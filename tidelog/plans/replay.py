"""Statement logs replayed into row changes, and consolidation plans put together from the operators."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.rules import FilterRules, ValueMap
from tidelog.operators import log as L
from tidelog.operators.apply import apply_statement, keyed_apply, statement_images
from tidelog.plans.registry import Registry


def target(sql: str) -> str:
    """The unqualified name of the table that an INSERT, UPDATE or DELETE writes; empty if there is none."""
    m = re.match(r"""(?is)\s*(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+((?:[\w$]+|"[^"]+"|`[^`]+`|\[[^\]]+\])(?:\s*\.\s*(?:[\w$]+|"[^"]+"|`[^`]+`|\[[^\]]+\]))*)""", sql)
    return re.split(r"\.(?=[^\"`\]]*$|[\"`\[])", m[1])[-1].strip().strip('"`[]') if m else ""


@dataclass
class Replica:
    """A small source's tables, kept as DataFrames while its statements are replayed in strict log order."""

    spark: SparkSession
    registry: Registry = field(default_factory=Registry)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    quarantine: list[tuple[str, str]] = field(default_factory=list)

    def run(self, sql: str, args: list | None = None) -> DataFrame | None:
        """Apply one statement; its row changes (op, before, after), None for DDL and what had to be put aside."""
        word = sql.lstrip()[:6].upper()
        if word in ("CREATE", "DROP T", "ALTER "):
            before = dict(self.registry.tables)
            self.registry.apply(sql)
            for t in set(before) - set(self.registry.tables):
                moved = [n for n in self.registry.tables if n not in before and self.registry.tables[n] == before[t]]
                if moved:
                    self.tables[moved[0]] = self.tables.pop(t)
                else:
                    self.tables.pop(t)
            for t, columns in self.registry.tables.items():
                if t not in self.tables:
                    self.tables[t] = self.spark.createDataFrame([], self.registry.schema(t))
                elif before.get(t) not in (None, columns):
                    old, new = before[t], columns
                    if len(old) == len(new):  # a renamed column keeps its place
                        self.tables[t] = self.tables[t].toDF(*(c.name for c in new))
                    self.tables[t] = self.registry.conform(self.tables[t], t)
            return None
        key = target(sql).upper()
        try:
            events = statement_images(self.tables[key], sql, args)
            self.tables[key] = apply_statement(self.tables[key], sql, args)
        except (KeyError, ValueError) as e:
            self.quarantine.append((sql, str(e)))
            return None
        return events.withColumn("table_name", F.lit(key))


@dataclass(frozen=True)
class Mapping:
    """What one destination wants: rules, value maps, and whether devices are tagged and share tables."""

    consolidated: bool = True
    filters: FilterRules | None = None
    values: ValueMap | None = None

    def apply(self, rows: DataFrame, table: str, device_id="device_id", device_name="device_name", updated="update_ts") -> DataFrame | None:
        """Rows of one source table as the destination takes them; None if it doesn't."""
        meta = [c for c in (device_id, device_name, updated) if c in rows.columns]
        body = self.values.project(rows, table) if self.values else rows
        if self.filters:
            own = [c for c in body.columns if c not in meta]
            kept = {c: n for c in own if (n := self.filters.column(table, c)) is not None}
            if self.filters.table(table) is None or not kept:
                return None
            body = body.select(*meta, *(F.col(f"`{c}`").alias(n) for c, n in kept.items()))
        if not self.consolidated:
            return body.drop(*meta)
        own = body.drop(*meta)
        return body.select(F.col(device_id).alias("src_device_id"), F.col(device_name).alias("src_device_name"), F.col(updated).alias("src_update_ts"), *(F.col(f"`{c}`") for c in own.columns))


def consolidate(changes: DataFrame, keys: list[str], state: DataFrame | None = None, parity: bool = False) -> DataFrame:
    """The flagship plan: committed changes only, then the latest of each device's key; changes carry device_id and sql for their fates."""
    good = L.committed(changes, parity).where("op is not null").drop("sql", "commit_id", "op")
    return keyed_apply(good, ["device_id", *keys], state=state)
