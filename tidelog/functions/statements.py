"""What a logged SQL statement is and names: Column expressions, and driver-side parsers for the few DDL texts."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of operations and the texts that mark them, tested in this order.
OPERATION_PREFIXES = (
    ("BEGIN", "BEGINTRAN"), ("COMMIT", "COMMITTRAN"), ("ROLLBACK", "ROLLBACKTRAN"), ("CHECKPOINT", "CHECKPOINTTRAN"),
    ("INSERT", "INSERT"), ("UPDATE", "UPDATE"), ("DELETE", "DELETE"), ("CREATE TABLE", "CREATETABLE"), ("DROP TABLE", "DROPTABLE"),
)
ALTERATIONS = ((" RENAME TO ", "RENAMETABLE"), (" ADD COLUMN ", "ADDCOLUMN"), (" DROP COLUMN ", "DROPCOLUMN"), (" RENAME COLUMN ", "RENAMECOLUMN"))
CONTROL_PREFIXES = ("BEGIN", "COMMIT", "ROLLBACK", "CHECKPOINT", "PRAGMA")
SERVER_CONTROL_PREFIXES = ("VACUUM", "ANALYZE")

_NAME = r'["`\[]?([^\s"`\[\](;]+)'


def _upper(sql: Column) -> Column:
    return F.upper(F.regexp_replace(sql, r"^\s+", ""))


def dml_kind(sql: Column) -> Column:
    """INSERT, UPDATE, DELETE or OTHER."""
    u = _upper(sql)
    return F.coalesce(*(F.when(u.startswith(k), F.lit(k)) for k in ("INSERT", "UPDATE", "DELETE")), F.lit("OTHER"))


def operation(sql: Column) -> Column:
    """One of 15 labels; NOOP if nothing matches."""
    u = _upper(sql)
    tests = [F.when(u.startswith(p), F.lit(label)) for p, label in OPERATION_PREFIXES]
    alter = u.startswith("ALTER TABLE")
    tests += [F.when(alter & u.contains(mark), F.lit(label)) for mark, label in ALTERATIONS]
    return F.coalesce(*tests, F.when(alter, F.lit("ALTERCOLUMN")), F.lit("NOOP"))


def table_name(sql: Column) -> Column:
    """The table a DML or DDL statement is about, unquoted, with its qualifiers; null if there is none."""
    lead = r"INSERT\b.*?\bINTO|UPDATE|DELETE\b.*?\bFROM|CREATE TABLE(?:\s+IF NOT EXISTS)?|DROP TABLE(?:\s+IF EXISTS)?|ALTER TABLE"
    return F.nullif(F.regexp_replace(F.regexp_extract(sql, rf"(?is)^\s*(?:{lead})\s+([^\s(;]+)", 1), r'["`\[\]]', ""), F.lit(""))


def bare_name(name: Column) -> Column:
    """Upper case, without quotes and qualifiers."""
    return F.upper(F.regexp_replace(F.substring_index(F.trim(name), ".", -1), '"', ""))


def is_internal_table(name: Column, prefix: str = "TIDELOG_") -> Column:
    """Tables of the engine itself: by prefix, or one of the metadata names."""
    return bare_name(name).startswith(prefix) | bare_name(name).isin("CHECKPOINT", "DASHBOARD", "DEVICE_STATUS")


def is_blocked_table(name: Column, prefix: str = "TIDELOG_") -> Column:
    """Tables that never leave their source."""
    return bare_name(name).isin(f"{prefix}TXN", "REPLAY_CHECKPOINT")


def is_control(sql: Column, server: bool = False) -> Column:
    """Statements that carry no change; on a server destination maintenance commands too."""
    u = _upper(sql)
    out = F.lit(False)
    for p in CONTROL_PREFIXES + (SERVER_CONTROL_PREFIXES if server else ()):
        out = out | u.startswith(p)
    return out


def _identifiers(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.regexp_replace(F.trim(x), r'^["`\[]|["`\]]$', "")), lambda x: x != "")


def insert_columns(sql: Column) -> Column:
    """The column list of INSERT INTO t (...); null without one."""
    found = F.regexp_extract(sql, rf"(?is)^\s*INSERT\b.*?\bINTO\s+{_NAME}[\"`\]]?\s*\(([^)]*)\)\s*(?:VALUES|SELECT)", 2)
    return F.when(found != "", _identifiers(found))


def _left_sides(text: Column, separator: str) -> Column:
    parts = F.filter(F.split(text, separator), lambda x: x.rlike("[=<>]"))
    return F.transform(parts, lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"(?s)^([^=<>!]*?)\s*(?:<>|!=|<=|>=|=|<|>)", 1)), r'^["`\[]|["`\]]$', ""))


def update_columns(sql: Column) -> Column:
    """Columns that SET assigns."""
    found = F.regexp_extract(sql, r"(?is)^\s*UPDATE\b.*?\sSET\s+(.*?)(?:\sWHERE\s.*)?$", 1)
    return F.when(found != "", _left_sides(found, ","))


def where_columns(sql: Column) -> Column:
    """Columns that the WHERE of an UPDATE or DELETE compares; empty without one."""
    found = F.regexp_extract(sql, r"(?is)^\s*(?:UPDATE|DELETE)\b.*?\sWHERE\s+(.*?);?\s*$", 1)
    return F.when(found != "", _left_sides(found, r"(?i)\sAND\s")).otherwise(F.array().cast("array<string>"))


def new_table_name(sql: Column) -> Column:
    """The new name, unqualified, of ALTER TABLE ... RENAME TO."""
    return F.nullif(F.substring_index(F.regexp_extract(sql, r'(?is)\sRENAME TO\s+["`\[]?([^\s"`\[\](;]+)', 1), ".", -1), F.lit(""))


def altered(sql: Column) -> Column:
    """(old_name, new_name) of an ALTER: added, dropped or renamed column, or the renamed table, unqualified."""
    def get(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(sql, pattern, group), F.lit(""))

    add, drop = rf"(?is)\sADD COLUMN\s+(?:IF NOT EXISTS\s+)?{_NAME}", rf"(?is)\sDROP COLUMN\s+(?:IF EXISTS\s+)?{_NAME}"
    rename = rf"(?is)\sRENAME COLUMN\s+{_NAME}[\"`\]]?\s+TO\s+{_NAME}"
    op = operation(sql)
    old = F.when(op == "DROPCOLUMN", get(drop, 1)).when(op == "RENAMECOLUMN", get(rename, 1)).when(op == "RENAMETABLE", F.substring_index(table_name(sql), ".", -1))
    new = F.when(op == "ADDCOLUMN", get(add, 1)).when(op == "RENAMECOLUMN", get(rename, 2)).when(op == "RENAMETABLE", new_table_name(sql))
    return F.struct(old.alias("old_name"), new.alias("new_name"))


def allowed(sql: Column, streaming: bool = False) -> Column:
    """Whether a restricted device takes a statement.

    A store device takes single-row INSERT ... VALUES, UPDATE and DELETE without sub-select or
    function call, CREATE/DROP/ALTER TABLE and SELECT; a streaming device no UPDATE and DELETE.
    """
    s = F.trim(F.coalesce(sql, F.lit("")))
    name = r"(?:[A-Za-z0-9_]+\.)?[A-Za-z0-9_]+"
    insert = s.rlike(rf"(?is)^\s*INSERT\s+INTO\s+{name}\s*(?:\([^)]+\))?\s*VALUES\s*\([^)]+\)\s*$")
    ddl = s.rlike(r"(?is)^\s*(?:CREATE|DROP|ALTER)\s+TABLE\b")
    select = s.rlike(r"(?is)^SELECT ")
    nested = r"(?i)\bSELECT\b|\b[A-Za-z_][A-Za-z0-9_]*\s*\("
    update, delete = rf"(?is)^\s*UPDATE\s+{name}\s+SET\s+(.+)$", rf"(?is)^\s*DELETE\s+FROM\s+{name}(?:\s+WHERE\s+(.+))?\s*$"
    change = s.rlike(update) & ~F.regexp_extract(s, update, 1).rlike(nested) | s.rlike(delete) & ~F.regexp_extract(s, delete, 1).rlike(nested)
    return insert | ddl | select | (F.lit(False) if streaming else change)


def full_width_insert(sql: Column, width: Column) -> Column:
    """Whether an INSERT supplies every column of a table of that many columns: by its list, else by its values."""
    values = F.regexp_extract(sql, r"(?is)VALUES\s*\((.*)\)\s*;?\s*$", 1)
    return F.coalesce(F.size(insert_columns(sql)), F.size(F.filter(F.split(values, ","), lambda x: F.trim(x) != ""))) == width


# --- driver-side parsers: a log holds few DDL statements ------------------------------------------


@dataclass(frozen=True)
class TableColumn:
    name: str
    type: str
    key_place: int = 0  # from 1 within the primary key


def _top_level(text: str) -> list[str]:
    out, depth, start, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(text[start:k])
            start = k + 1
    return [p for p in (x.strip() for x in [*out, text[start:]]) if p]


_STRIP = '"`[]'


def parse_create(sql: str) -> tuple[str, list[TableColumn]]:
    """Table and columns of a CREATE TABLE; its key may stand with a column or in a clause of its own."""
    m = re.match(r"(?is)\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([^\s(]+)\s*\((.*)\)[^)]*$", sql)
    if not m:
        raise ValueError(f"not a CREATE TABLE: {sql!r}")
    columns, key = [], []
    for part in _top_level(m[2]):
        head = part.upper()
        if clause := re.match(r"(?is)(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\(([^)]*)\)", part):
            key = [x.strip().strip(_STRIP).upper() for x in clause[1].split(",")]
        elif not re.match(r"(UNIQUE|CONSTRAINT|FOREIGN\s+KEY|CHECK)\b", head):
            name, _, rest = part.partition(" ")
            type_ = re.split(r"(?i)\s+(?:PRIMARY|NOT|NULL|DEFAULT|UNIQUE|CHECK|REFERENCES|COLLATE|GENERATED|AUTOINCREMENT|CONSTRAINT)\b", " " + rest.strip())[0].strip()
            if re.search(r"\bPRIMARY\s+KEY\b", head):
                key = [name.strip(_STRIP).upper()]
            columns.append(TableColumn(name.strip(_STRIP), type_))
    place = {k: i + 1 for i, k in enumerate(key)}
    return m[1].strip(_STRIP + ";"), [TableColumn(c.name, c.type, place.get(c.name.upper(), 0)) for c in columns]


_PIECE = re.compile(r"""'(?:[^']|'')*(?:'|$)|"(?:[^"]|"")*(?:"|$)|--[^\n]*(?:\n|$)|/\*.*?(?:\*/|$)|;|[^'"\-/;]+|.""", re.S)


def split_statements(script: str) -> list[str]:
    """Statements of a script, parted at semicolons outside quotes and comments; comments are dropped."""
    out, now = [], ""
    for piece in _PIECE.findall(script):
        if piece.startswith(("--", "/*")):
            continue
        if piece == ";":
            out.append(now)
            now = ""
        else:
            now += piece
    return [s for s in (x.strip() for x in [*out, now]) if s]


def transaction_message(sql: str) -> str | None:
    """begin, commit or rollback if the statement is that and so toggles auto-commit."""
    word = re.match(r"\s*([a-z]*)", sql.lower())[1]
    for message, heads in (("begin", ("begin",)), ("commit", ("end", "commit")), ("rollback", ("rollback",))):
        if word.startswith(heads):
            return message
    return None


def literal(value) -> str:
    """A value as SQL text, for exports: null, integer, finite real, quoted text, hex blob."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def bind(sql: str, args: list) -> str:
    """sql with its ? outside quotes replaced by literals; too few arguments leave NULL."""
    rest = iter(args)
    pieces = re.split(r"""('(?:[^']|'')*'|"(?:[^"]|"")*")""", sql)
    return "".join(p if k % 2 else re.sub(r"\?", lambda _: literal(next(rest, None)), p) for k, p in enumerate(pieces))


def quote(name: str, quoted: bool = True) -> str:
    return '"' + name.replace('"', '""') + '"' if quoted else name


def qualify(table: str, catalog: str = "", schema: str = "", quoted: bool = True) -> str:
    return ".".join(quote(p, quoted) for p in (catalog, schema, table) if p)


def event_sql(op: str, table: str, columns: list[str]) -> str:
    """The parameterised statement that applies a row image."""
    equal = " AND ".join(f"{quote(c)} = ?" for c in columns)
    if op == "INSERT":
        return f"INSERT INTO {quote(table)} ({', '.join(map(quote, columns))}) VALUES ({', '.join('?' * len(columns))})"
    if op == "UPDATE":
        return f"UPDATE {quote(table)} SET {', '.join(f'{quote(c)} = ?' for c in columns)} WHERE {equal}"
    return f"DELETE FROM {quote(table)} WHERE {equal}"


def prefix_values(sql: str, n: int) -> str:
    """A one-tuple INSERT with n more parameters in front of its values."""
    return re.sub(r"(?i)(VALUES\s*\()", lambda m: m[1] + "?, " * n, sql, count=1)
