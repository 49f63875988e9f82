"""Changes folded into tables: by key, as a bag, or by the statements' own predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.session import cut

ORDER = ["segment_seq", "change_number"]


def signed(changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Changes with before and after structs as (key, values, deleted): an UPDATE that moves a key deletes the old one first."""
    columns = [*keys, *values]
    old, new = [F.col(f"before.{c}").alias(c) for c in columns], [F.col(f"after.{c}").alias(c) for c in columns]
    rest = [c for c in changes.columns if c not in ("before", "after")]
    gone = changes.where("before is not null").select(*rest, *old, F.lit(True).alias("deleted"), F.lit(0).alias("ordinal"))
    there = changes.where("after is not null").select(*rest, *new, F.lit(False).alias("deleted"), F.lit(1).alias("ordinal"))
    return gone.unionByName(there)


def keyed_apply(changes: DataFrame, keys: list[str], order: list[str] = ORDER, state: DataFrame | None = None) -> DataFrame:
    """Live rows after upserts and deletes (boolean column deleted), on top of a state if given.

    The latest change of a key decides. It is a maximum of one struct a key, so each task sends one
    row a key however many changes a key has, and a hot key costs no more than any other.
    """
    values = [c for c in changes.columns if c not in (*keys, *order)]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_l")).select(*keys, "_l.*")
    if state is not None:
        untouched = state.join(latest.select(*keys), keys, "left_anti")
        return untouched.unionByName(latest.where("not deleted").drop("deleted"), allowMissingColumns=True)
    return latest.where("not deleted").drop("deleted")


def keyed_merge(changes: DataFrame, keys: list[str], state: DataFrame | None = None, order: list[str] = ORDER) -> DataFrame:
    """A state that keeps each key's latest change with its order, deletes included: keys, values, deleted, order.

    Applied again, or in any order of batches, changes lead to the same state. live() shows its rows.
    """
    rows = changes if state is None else changes.unionByName(state, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def live(state: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """The rows of keyed_merge() that are not deleted."""
    return state.where("not deleted").drop("deleted", *order)


def insert_only(changes: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """Duplicate inserts ignored: the first of each key stays."""
    values = [c for c in changes.columns if c not in (*keys, *order)]
    return changes.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def bag_apply(changes: DataFrame, group: list[str], order: list[str] = ORDER) -> DataFrame:
    """group, image (array of text), copies after folding images without a key.

    An INSERT adds a copy; a DELETE takes all rows equal to its before image on every column, an
    UPDATE moves them; an image with a null equals nothing. Order matters within a group only, a
    device's table; changes with the same order follow each other in an arbitrary, but fixed way.

    Nothing is folded one by one: what comes to an image stays until the next change that takes the
    image away, found by a window, and goes on from there with all else that it took. These links
    are doubled until each shows where it ends, so rounds grow with the logarithm of the longest
    chain of updates; without any row that is inserted and taken away later there are none.
    """
    keys = list(dict.fromkeys([*group, *order]))
    insert = F.col("op").eqNullSafe("INSERT")
    takes = ~insert & F.col("before").isNotNull() & ~F.exists("before", lambda x: x.isNull()) & ~F.col("before").eqNullSafe(F.col("after"))

    def at(image: str, kind: str):
        return F.struct(F.col(image).cast("array<string>").alias("image"), F.lit(kind).alias("_kind"))

    ends = F.array_compact(F.array(F.when(takes, at("before", "from")), F.when(insert, at("after", "new")).when(takes & (F.col("op") == "UPDATE"), at("after", "to"))))
    rows = changes.select(*keys, F.xxhash64("op", "before", "after").alias("_h"), F.inline(ends))
    change = F.struct(*keys, "_h")
    latest_first = Window.partitionBy(*group, "image").orderBy(*(F.col(c).desc_nulls_first() for c in order), F.col("_h").desc())
    taken = F.last(F.when(F.col("_kind") == "from", change), ignorenulls=True).over(latest_first.rowsBetween(Window.unboundedPreceding, 0))
    comes = rows.withColumns({"_by": change, "_next": taken})

    new = cut(comes.where("_kind = 'new'").groupBy(*group, "image", "_next").agg(F.count("*").alias("copies")))
    stay, go = new.where("_next is null").drop("_next"), new.where("_next is not null")
    if not go.isEmpty():
        links = cut(comes.where("_kind = 'to'").select("_by", "_next", "image").distinct())
        ended, on = links.where("_next is null"), links.where("_next is not null")
        while not on.isEmpty():
            further = ended.unionByName(on).select(F.col("_by").alias("_next"), F.col("_next").alias("_then"), "image")
            links = cut(on.drop("image").join(further, "_next").select("_by", F.col("_then").alias("_next"), "image"))  # what a DELETE takes has no link
            ended, on = ended.unionByName(links.where("_next is null")), links.where("_next is not null")
        moved = go.drop("image").join(ended.select(F.col("_by").alias("_next"), "image"), "_next")
        stay = stay.unionByName(moved.select(*group, "image", "copies")).groupBy(*group, "image").agg(F.sum("copies").alias("copies"))
    image = F.coalesce("image", F.raise_error(F.lit("a row without an image")).cast("array<string>"))
    return stay.select(*group, image.alias("image"), "copies")


# A statement's tokens: text, blob, quoted names, numbers, words, and single marks.
_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|[xX]'[0-9a-fA-F]*'|'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[A-Za-z_][\w$]*|\|\||<>|!=|<=|>=|==|<<|>>|.""", re.S)
#: What a replay can't repeat, as each run has another result, and what reads another table.
_UNREPEATABLE = frozenset("RANDOM RAND RANDN UUID NOW CURRENT_TIMESTAMP CURRENT_DATE CURRENT_TIME SHUFFLE SELECT EXISTS".split())


def _tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql.strip().rstrip(";")) if not t.isspace() and not t.startswith(("--", "/*"))]


def _upto(tokens: list[str], stops: tuple[str, ...]) -> int:
    """The place of the first of the words or marks outside parentheses, or the end."""
    depth = 0
    for k, t in enumerate(tokens):
        if depth == 0 and t.upper() in stops:
            return k
        depth += (t == "(") - (t == ")")
    return len(tokens)


def _parts(tokens: list[str]) -> list[list[str]]:
    """What commas outside parentheses part."""
    out = []
    while True:
        k = _upto(tokens, (",",))
        out.append(tokens[:k])
        if k == len(tokens):
            return out
        tokens = tokens[k + 1 :]


def _name(token: str) -> str:
    return token[1:-1].replace('""', '"') if token[0] in '"`[' else token


def _literal(value) -> str:
    """A bound value as Spark's SQL writes it."""
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, float):
        return f"double('{value}')"
    if isinstance(value, (bool, int)):
        return f"({int(value)}{'L' if abs(int(value)) < 2**63 else ''})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(tokens: list[str], args: list):
    """An expression that Spark's own parser reads, once parameters are bound and the dialect's quotes replaced; LIKE ignores case, as there."""
    if not tokens:
        raise ValueError("not supported: an empty expression")
    out = []
    for t in tokens:
        if t == "?":
            if not args:
                raise ValueError("not supported: more parameters than values")
            out.append(_literal(args.pop(0)))
        elif t.upper() in _UNREPEATABLE:
            raise ValueError(f"not supported: {t}")
        elif t[0] == "'":
            out.append(_literal(t[1:-1].replace("''", "'")))
        elif t[0] in '"`[' and len(t) > 1:
            out.append("`" + _name(t).replace("`", "``") + "`")
        elif re.fullmatch(r"(?=.*[.eE])[\d.]+(?:[eE][+-]?\d+)?", t):
            out.append(f"double('{t}')")
        else:
            out.append({"LIKE": "ILIKE", "IFNULL": "COALESCE"}.get(t.upper(), t))
    return F.expr(" ".join(out))


def _parsed(sql: str) -> dict:
    """A statement's kind and its pieces as tokens; ValueError for shapes that can't be replayed from one table."""
    t = _tokens(sql)
    up = [x.upper() for x in t]
    if up[:2] == ["INSERT", "INTO"] and len(t) > 3:
        k = 3
        while k + 1 < len(t) and t[k] == ".":  # a qualified name
            k += 2
        name, names = _name(t[k - 1]), None
        if k < len(t) and t[k] == "(":
            end = k + 1 + _upto(t[k + 1 :], (")",))
            names, k = [_name(p[0]) for p in _parts(t[k + 1 : end])], end + 1
        if k < len(t) and up[k] == "VALUES":
            rows = _parts(t[k + 1 :])
            if all(r and r[0] == "(" and r[-1] == ")" for r in rows):
                return {"kind": "VALUES", "table": name, "names": names, "rows": [_parts(r[1:-1]) for r in rows]}
        if k < len(t) and up[k] == "SELECT":
            rest = t[k + 1 :]
            source = _upto(rest, ("FROM",))
            after = rest[source + 1 :]
            where = _upto(after, ("WHERE",))
            if where and all(x == "." or k % 2 == 0 for k, x in enumerate(after[:where])) and _name(after[where - 1]).upper() == name.upper():
                return {"kind": "SELECT", "table": name, "names": names, "what": _parts(rest[:source]), "where": after[where + 1 :]}
    if up[:1] == ["UPDATE"] and "SET" in up:
        k = up.index("SET")
        rest = t[k + 1 :]
        where = _upto(rest, ("WHERE",))
        sets = {}
        for p in _parts(rest[:where]):
            if len(p) < 3 or p[1] != "=":
                raise ValueError(f"not supported: {sql!r}")
            sets[_name(p[0]).lower()] = p[2:]
        return {"kind": "UPDATE", "sets": sets, "where": rest[where + 1 :]}
    if up[:2] == ["DELETE", "FROM"]:
        where = _upto(t, ("WHERE",))
        if where <= 3 + 2 * t[3:where].count("."):
            return {"kind": "DELETE", "where": t[where + 1 :]}
    raise ValueError(f"not supported: {sql!r}")


def _into(columns: list[str], names: list[str] | None, n: int, sql: str) -> list[str]:
    """The columns that n values go into; an error if there are others of them, or unknown ones."""
    low = {c.lower(): c for c in columns}
    into = [x.lower() for x in names] if names else list(low)
    if unknown := [x for x in into if x not in low]:
        raise ValueError(f"no such column {unknown[0]}: {sql!r}")
    if len(into) != n:
        raise ValueError(f"{n} values for {len(into)} columns: {sql!r}")
    return [low[x] for x in into]


def _checked(make, sql: str):
    """make(), with what Spark can't read or resolve as a ValueError."""
    try:
        return make()
    except (AnalysisException, ParseException) as e:
        raise ValueError(f"not supported: {sql!r}: {str(e).splitlines()[0]}") from e


def _inserted(state: DataFrame, p: dict, sql: str, args: list) -> DataFrame:
    columns, types = state.columns, dict(state.dtypes)

    def rows_of(values) -> list:
        into = dict(zip(_into(columns, p["names"], len(values), sql), values))
        return [into.get(c, F.lit(None)).try_cast(types[c]).alias(c) for c in columns]

    if p["kind"] == "SELECT":
        what = [F.col(c) for c in columns] if p["what"] == [["*"]] else [_column(x, args) for x in p["what"]]
        rows = state.where(_column(p["where"], args)) if p["where"] else state
        return rows.select(*rows_of(what))
    return state.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*rows_of([_column(v, args) for v in r])) for r in p["rows"]))))


def _updated(state: DataFrame, p: dict, sql: str, args: list) -> dict:
    """The new value of each column that is set."""
    types = {c.lower(): t for c, t in state.dtypes}
    if unknown := [c for c in p["sets"] if c not in types]:
        raise ValueError(f"no such column {unknown[0]}: {sql!r}")
    return {c: _column(x, args).try_cast(types[c]) for c, x in p["sets"].items()}


def statement_images(state: DataFrame, sql: str, args: list | None = None) -> DataFrame:
    """(op, before, after) for each row that a statement on this state affects; one event a row.

    Shapes: INSERT with rows of values, INSERT from a SELECT on the same table, UPDATE and DELETE
    with any condition on one row that Spark's parser reads. Others, unknown columns, and another
    number of values than columns raise ValueError, for the caller to put aside.
    """

    def make() -> DataFrame:
        given, p = list(args or []), _parsed(sql)
        row = F.struct(*state.columns)
        none = F.lit(None).cast(state.select(row.alias("r")).schema["r"].dataType)
        if p["kind"] in ("VALUES", "SELECT"):
            return _inserted(state, p, sql, given).select(F.lit("INSERT").alias("op"), none.alias("before"), row.alias("after"))
        sets = _updated(state, p, sql, given) if p["kind"] == "UPDATE" else {}
        rows = state.where(_column(p["where"], given)) if p["where"] else state
        if p["kind"] == "DELETE":
            return rows.select(F.lit("DELETE").alias("op"), row.alias("before"), none.alias("after"))
        new = F.struct(*(sets.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in state.columns))
        return rows.select(F.lit("UPDATE").alias("op"), row.alias("before"), new.alias("after"))

    return _checked(make, sql)


def apply_statement(state: DataFrame, sql: str, args: list | None = None) -> DataFrame:
    """The state after one statement, its own predicate deciding which rows it meets."""

    def make() -> DataFrame:
        given, p = list(args or []), _parsed(sql)
        if p["kind"] in ("VALUES", "SELECT"):
            return state.unionByName(_inserted(state, p, sql, given))
        sets = _updated(state, p, sql, given) if p["kind"] == "UPDATE" else {}
        met = F.coalesce(_column(p["where"], given).cast("boolean"), F.lit(False)) if p["where"] else F.lit(True)
        if p["kind"] == "DELETE":
            return state.where(~met)
        return state.select(*(F.when(met, sets[c.lower()]).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() in sets else F.col(f"`{c}`") for c in state.columns))

    return _checked(make, sql)


def apply_statements(state: DataFrame, statements: list[tuple[str, list]], cut_every: int = 20) -> DataFrame:
    """Statements in commit order; the plan is cut now and then where a checkpoint folder is set."""
    for k, (sql, args) in enumerate(statements, 1):
        state = apply_statement(state, sql, args)
        if k % cut_every == 0 and state.sparkSession.sparkContext.getCheckpointDir():
            state = state.checkpoint()
    return state


def fan_in(tables: list[DataFrame]) -> DataFrame:
    """Many devices' rows in one table, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def fan_out(changes: DataFrame, destinations: dict) -> dict[str, DataFrame]:
    """One branch of the same changes for each destination's own mapping (a function); nulls are blocked tables."""
    return {name: out for name, mapping in destinations.items() if (out := mapping(changes)) is not None}


def unparsable(rows: DataFrame, types: dict[str, str], mode: str = "null") -> DataFrame:
    """Text columns cast to types; what can't be read becomes null, or its row goes (mode drop)."""
    cast = {c: F.col(c).try_cast(t) for c, t in types.items()}
    if mode == "drop":
        rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNull() | x.isNotNull() for c, x in cast.items()), F.lit(True)))
    return rows.withColumns(cast)


# What an error's text says about retrying it, and DDL errors that don't matter.
FATAL = ("syntax", "no such table", "no such column", "duplicate", "unique constraint", "primary key")
PASSING = ("busy", "locked", "deadlock", "timeout", "connection", "transient")
BENIGN_DDL = ("duplicate column", "already exists", "no such column", "unknown column", "can't drop", "does not exist", "doesn't exist", "column not found", "unknown table", "no such table", "table not found")


def _any(text, words):
    return reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in words))


def retriable(message, backend=None):
    """Whether an error may pass if tried again; server errors of classes 2, 3 and 5 never do."""
    server = (backend == "postgres") & F.lower(message).contains("pg[235") if backend is not None else F.lit(False)
    return ~_any(message, FATAL) & ~server & _any(message, PASSING)


def benign_ddl(message):
    return _any(message, BENIGN_DDL)
