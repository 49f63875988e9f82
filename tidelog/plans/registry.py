"""The schema registry: DDL folded in log order into versions of each device's tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.statements import TableColumn, parse_create
from tidelog.functions.types import SPARK_TYPES, family

BOOKKEEPING = ("src_device_id", "src_device_name", "src_update_ts")


@dataclass
class Registry:
    """Tables of one device, column order kept; names compare without case. ``consolidated`` never loses a column or a table."""

    consolidated: bool = False
    tables: dict[str, list[TableColumn]] = field(default_factory=dict)
    versions: list[tuple[tuple, str, list[TableColumn]]] = field(default_factory=list)

    def apply(self, sql: str, at: tuple = ()) -> None:
        """One DDL statement; those that have already taken effect, or meet nothing, change nothing."""
        name = r'["`\[]?([\w.]+)["`\]]?'
        if re.match(r"(?is)\s*CREATE\s+TABLE", sql):
            table, columns = parse_create(sql)
            table = self._bare(table)
            if table not in self.tables:
                self.tables[table] = columns
            elif self.consolidated:
                self.tables[table] = [*self.tables[table], *(c for c in columns if not self._has(table, c.name))]
        elif m := re.match(rf"(?is)\s*DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{name}", sql):
            table = self._bare(m[1])
            if not self.consolidated:
                self.tables.pop(table, None)
        elif m := re.match(rf"(?is)\s*ALTER\s+TABLE\s+{name}\s+RENAME\s+TO\s+{name}", sql):
            old, table = self._bare(m[1]), self._bare(m[2])
            if old in self.tables and table not in self.tables:
                self.tables[table] = list(self.tables[old]) if self.consolidated else self.tables.pop(old)
        elif m := re.match(rf"(?is)\s*ALTER\s+TABLE\s+{name}\s+ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{name}\s*(.*?);?\s*$", sql):
            table = self._bare(m[1])
            if table in self.tables and not self._has(table, m[2]):
                type_ = re.split(r"(?i)\s+(?:NOT|NULL|DEFAULT|CHECK)\b", " " + m[3])[0].strip()
                self.tables[table] = [*self.tables[table], TableColumn(m[2], type_)]
        elif m := re.match(rf"(?is)\s*ALTER\s+TABLE\s+{name}\s+DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?{name}", sql):
            table = self._bare(m[1])
            if not self.consolidated and table in self.tables:
                self.tables[table] = [c for c in self.tables[table] if c.name.upper() != m[2].upper()]
        elif m := re.match(rf"(?is)\s*ALTER\s+TABLE\s+{name}\s+RENAME\s+COLUMN\s+{name}\s+TO\s+{name}", sql):
            table = self._bare(m[1])
            if table in self.tables and not self._has(table, m[3]):
                renamed = [TableColumn(m[3], c.type, 0 if self.consolidated else c.key_place) for c in self.tables[table] if c.name.upper() == m[2].upper()]
                if self.consolidated:
                    self.tables[table] = [*self.tables[table], *renamed]
                elif renamed:
                    self.tables[table] = [renamed[0] if c.name.upper() == m[2].upper() else c for c in self.tables[table]]
        else:
            return
        self.versions.append((at, table, list(self.tables.get(table, []))))

    @staticmethod
    def _bare(name: str) -> str:
        return name.rsplit(".", 1)[-1].strip('"`[]').upper()

    def _has(self, table: str, column: str) -> bool:
        return any(c.name.upper() == column.upper() for c in self.tables[table])

    def keys(self, table: str) -> list[str]:
        return [c.name for c in sorted(self.tables[table.upper()], key=lambda c: c.key_place) if c.key_place]

    def schema(self, table: str) -> str:
        """Spark DDL of the destination table; bookkeeping columns first if consolidated."""
        own = [f"`{c.name}` {SPARK_TYPES[family(c.type)]}" for c in self.tables[table.upper()]]
        return ", ".join([*(f"{b} string" for b in BOOKKEEPING if self.consolidated), *own])

    def conform(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows of any earlier version in the table's present shape: by name, missing columns null, unknown ones left out."""
        have = {c.upper(): c for c in rows.columns}
        names = [*(b for b in BOOKKEEPING if self.consolidated and b.upper() in have), *(c.name for c in self.tables[table.upper()])]
        types = {c.name: SPARK_TYPES[family(c.type)] for c in self.tables[table.upper()]}
        return rows.select(*((F.col(f"`{have[n.upper()]}`") if n.upper() in have else F.lit(None)).cast(types.get(n, "string")).alias(n) for n in names))


def fold(log: DataFrame, consolidated: bool = False) -> dict[str, Registry]:
    """The registry of each device. A log's DDL is little, and its fold is sequential, so it is done on the driver."""
    from tidelog.functions.statements import operation

    ddl = log.where(operation(F.col("sql")).isin("CREATETABLE", "DROPTABLE", "RENAMETABLE", "ADDCOLUMN", "DROPCOLUMN", "RENAMECOLUMN", "ALTERCOLUMN"))
    out: dict[str, Registry] = {}
    for r in ddl.select("device_id", "segment_seq", "change_number", "sql").orderBy("device_id", "segment_seq", "change_number").toLocalIterator():
        out.setdefault(r.device_id, Registry(consolidated)).apply(r.sql, (r.segment_seq, r.change_number))
    return out


def versions(spark: SparkSession, registries: dict[str, Registry]) -> DataFrame:
    """(device_id, segment_seq, change_number, table_name, width, columns): what a table looked like from a point of the log on."""
    rows = [(d, *at, t, len(cols), [c.name for c in cols]) for d, reg in registries.items() for at, t, cols in reg.versions]
    return spark.createDataFrame(rows, "device_id string, segment_seq long, change_number long, table_name string, width int, columns array<string>")


def attach_versions(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Each change with the table version in force: the last at or before it, carried forward over the union of both."""
    from pyspark.sql import Window

    marks = known.select("device_id", "table_name", "segment_seq", "change_number", F.struct("width", "columns").alias("_v"), F.lit(0).alias("_kind"))
    rows = changes.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("device_id", "table_name").orderBy("segment_seq", "change_number", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    return filled.select(*changes.columns, "_v.width", "_v.columns")
