"""Rules that shape what reaches a destination: which tables and columns, under which names, with which values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.types import cell_text


def parse_properties(text: str) -> dict[str, str]:
    """key = value lines; blank ones and # comments are skipped."""
    out = {}
    for line in (x.strip() for x in text.splitlines()):
        if line and not line.startswith("#"):
            key, eq, value = line.partition("=")
            if not eq:
                raise ValueError(f"no = in {line!r}")
            out[key.strip()] = value.strip()
    return out


@dataclass(frozen=True)
class FilterRules:
    """true allows, false blocks, anything else renames; keys are TABLE or TABLE.COLUMN in upper case."""

    tables: dict[str, str] = field(default_factory=dict)
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    unspecified_tables: bool = False
    unspecified_columns: bool = True

    @classmethod
    def parse(cls, text: str, unspecified_tables: bool = False, unspecified_columns: bool = True) -> FilterRules:
        tables, columns = {}, {}
        for key, value in parse_properties(text).items():
            table, *rest = key.upper().split(".")
            if len(rest) > 1:
                raise ValueError(f"neither a table nor a column: {key}")
            if rest:
                columns.setdefault(table, {})[rest[0]] = value
            else:
                tables[table] = value
        return cls(tables, columns, unspecified_tables, unspecified_columns)

    @staticmethod
    def _apply(rules: dict[str, str], name: str, default: bool) -> str | None:
        rule = rules.get(name.upper(), str(default).lower())
        return {"true": name, "false": None}.get(rule, rule)

    def table(self, name: str) -> str | None:
        """The table's name at the destination, None if blocked."""
        return self._apply(self.tables, name, self.unspecified_tables)

    def column(self, table: str, name: str) -> str | None:
        """Likewise for a column; a table without column rules lets all through."""
        rules = self.columns.get(table.upper())
        return name if rules is None else self._apply(rules, name, self.unspecified_columns)

    def table_expression(self, name: Column) -> Column:
        """table() as an expression, for logs with a column of table names."""
        if not self.tables:
            return name if self.unspecified_tables else F.lit(None).cast("string")
        rule = F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(self.tables.items()))), F.upper(name))
        rule = F.coalesce(rule, F.lit(str(self.unspecified_tables).lower()))
        return F.when(rule == "true", name).when(rule != "false", rule)

    def project(self, rows: DataFrame, table: str) -> DataFrame | None:
        """Rows of one table with the columns allowed, renamed; None if the table or all its columns are blocked."""
        kept = {c: new for c in rows.columns if (new := self.column(table, c)) is not None}
        if self.table(table) is None or not kept:
            return None
        return rows.select(*(F.col(f"`{c}`").alias(new) for c, new in kept.items()))

    def image(self, table: Column, image: Column) -> Column:
        """A map image (column to text) with the columns allowed, renamed; column rules of every table known."""
        out = image
        for t, rules in self.columns.items():
            known = F.create_map(*map(F.lit, chain.from_iterable(rules.items())))
            default = F.lit(str(self.unspecified_columns).lower())
            kept = F.map_filter(image, _allowed(known, default))
            renamed = F.transform_keys(kept, _renamed(known, default))
            out = F.when(F.upper(table) == t, renamed).otherwise(out)
        return out


def _allowed(known: Column, default: Column):
    return lambda k, v: F.coalesce(F.try_element_at(known, F.upper(k)), default) != "false"


def _renamed(known: Column, default: Column):
    def rename(k: Column, v: Column) -> Column:
        rule = F.coalesce(F.try_element_at(known, F.upper(k)), default)
        return F.when(rule == "true", k).otherwise(rule)

    return rename


@dataclass(frozen=True)
class ValueMap:
    """Replacement texts by TABLE.COLUMN and the cell's text."""

    maps: dict[str, dict[str, str]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> ValueMap:
        return cls({k.upper(): dict(v) for k, v in json.loads(text).items()})

    def column(self, table: str, name: str, value: Column, kind: str = "string") -> Column:
        """The cell replaced if its text, or that without trailing spaces, is a key; else the text itself, null staying null."""
        known = self.maps.get(f"{table}.{name}".upper())
        if not known:
            return value
        table_ = F.create_map(*map(F.lit, chain.from_iterable(known.items())))
        text = cell_text(value, kind)
        return F.coalesce(F.try_element_at(table_, text), F.try_element_at(table_, F.regexp_replace(text, " +$", "")), F.when(value.isNotNull(), text))

    def project(self, rows: DataFrame, table: str) -> DataFrame:
        kinds = dict(rows.dtypes)
        return rows.select(*(self.column(table, c, F.col(f"`{c}`"), kinds[c]).alias(c) for c in rows.columns))


# How a destination's tables are prepared, as (create, empty first).
INIT_MODES = {
    "OVERWRITE_OBJECT": (True, True), "TRY_CREATE_DELETE_DATA": (True, True), "TRY_CREATE_APPEND_DATA": (True, False),
    "DELETE_DATA": (False, True), "APPEND_DATA": (False, False),
}


def selected_tables(names: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Tables for a snapshot: those included (all if none are named) less those excluded, whatever the case."""
    wanted, unwanted = {x.upper() for x in include}, {x.upper() for x in exclude}
    return [n for n in names if (not wanted or n.upper() in wanted) and n.upper() not in unwanted]


def update_text(epoch_ms: Column) -> Column:
    """UTC to the second, as text."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(epoch_ms), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def tag(rows: DataFrame, device_id, device_name, updated) -> DataFrame:
    """Rows of a consolidated table: the source device and the time of the update in front."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(lit(device_id).alias("src_device_id"), lit(device_name).alias("src_device_name"), lit(updated).alias("src_update_ts"), *(F.col(f"`{c}`") for c in rows.columns))


def mapper_of(mode: str, internal: Column) -> Column:
    """Which mapping an entry takes: consolidation always in that mode; replication except for the engine's own tables."""
    return F.lit("CONSOLIDATION") if mode == "CONSOLIDATION" else F.when(internal, F.lit("CONSOLIDATION")).otherwise(F.lit("REPLICATION"))
