"""Column types of a source, mapped for a destination."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens of source types by the family they map to. Unknown tokens are text.
FAMILIES = {
    "integer": "smallserial serial bigserial bit integer int tinyint smallint mediumint bigint int2 int4 int8 long byteint unsigned",
    "blob": "blob bytea binary varbinary image object geography geometry raw sdo_geometry sdo_topo_geometry bfile ref ordicom ordaudio ordvideo orddoc table associative varray graphic vargraphic",
    "real": "real double float numeric money smallmoney number decimal binary_float binary_double",
    "boolean": "boolean bool",
    "time": "date datetime datetime2 time timestamp",
    "array": "array integer[ bigint[ text[ boolean[ float[ numeric[ timestamp[ date[ time[ character[ json[ jsonb[ vector",
}
TARGETS = {
    "duckdb": {"integer": "bigint", "blob": "blob", "real": "double", "boolean": "boolean", "time": "timestamp", "array": "text", "text": "text"},
    "postgres": {"integer": "bigint", "blob": "bytea", "real": "double precision", "boolean": "boolean", "time": "timestamp", "text": "text"},
}
SPARK_TYPES = {"integer": "bigint", "blob": "binary", "real": "double", "boolean": "boolean", "time": "timestamp_ntz", "array": "string", "text": "string"}
MODES = ("BEST_EFFORT", "ALL_TEXT", "CUSTOMIZED", "EXACT")
_FAMILY = {token: family for family, tokens in FAMILIES.items() for token in tokens.split()}


def token(declared: str) -> str:
    """The word that decides: lower case, up to white space or a parenthesis, an array's bracket kept."""
    word = re.split(r"[\s(]", declared.strip().lower(), maxsplit=1)[0]
    return word[: word.index("[") + 1] if "[" in word else word


def family(declared: str) -> str:
    return _FAMILY.get(token(declared), "text")


def map_type(declared: str, destination: str, mode: str = "BEST_EFFORT", overrides: dict[str, str] | None = None, vectors: bool = False) -> str:
    """The destination's type for a declared source type."""
    source = declared.strip()
    if mode == "EXACT" and source:
        return source
    if mode == "CUSTOMIZED" and source and (own := _override(source.lower(), overrides or {})):
        return own
    if mode != "BEST_EFFORT" or not source:
        blob = source.lower() == "blob"
        return ("BYTEA" if blob else "TEXT") if destination == "postgres" else "blob" if blob else "text"
    if destination == "sqlite":
        return source
    kind = family(source)
    if kind == "array" and destination == "postgres":
        return "VECTOR" if vectors and re.match(r"(?i)float|vector", source) else source
    return TARGETS[destination][kind]


def _override(source: str, overrides: dict[str, str]) -> str | None:
    """Exact key first, then base(length), then base(precision,scale); a placeholder on the right keeps the arguments."""
    if source in overrides:
        return overrides[source]
    if "(" in source:
        base = source[: source.index("(")].strip()
        for arguments in ("(length)", "(precision,scale)"):
            if (target := overrides.get(base + arguments)) is not None:
                target = target.lower()
                return source.replace(base, target[: target.index("(")].strip(), 1) if arguments in target else target
    return None


def mapped(declared: Column, destination: str) -> Column:
    """BEST_EFFORT as an expression, for columns of type names."""
    if destination == "sqlite":
        return declared
    word = F.regexp_replace(F.regexp_extract(F.lower(F.trim(declared)), r"^([^\s(]*)", 1), r"\[.*$", "[")
    families = F.create_map(*map(F.lit, chain.from_iterable(_FAMILY.items())))
    kind = F.coalesce(F.try_element_at(families, word), F.lit("text"))
    targets = F.create_map(*map(F.lit, chain.from_iterable(TARGETS[destination].items())))
    empty = F.trim(declared) == ""
    return F.when(empty, F.lit("TEXT" if destination == "postgres" else "text")).otherwise(F.coalesce(F.try_element_at(targets, kind), declared))


def typed(value: Column, declared: str, unparsable: str = "null") -> Column:
    """A text cell as the Spark type of a declared type; what can't be read is null, or an error if strict."""
    to = SPARK_TYPES[family(declared)]
    if to == "binary":
        return F.unhex(value)
    return value.cast(to) if unparsable == "error" else value.try_cast(to)


def cell_text(value: Column, kind: str) -> Column:
    """A cell as the text that value maps are keyed by: integral reals without a fraction, blobs in upper hex, null as 'null'."""
    if kind == "binary":
        out = F.hex(value)
    elif kind == "double":
        whole, text = value.try_cast("decimal(38,0)"), value.cast("string")
        plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), "0+$", "")
        out = F.when(value == F.rint(value), F.coalesce(whole.cast("string"), text)).when(text.contains("E"), F.coalesce(plain, text)).otherwise(text)
    elif kind == "boolean":
        out = value.cast("int").cast("string")
    else:
        out = value.cast("string")
    return F.coalesce(out, F.lit("null"))
