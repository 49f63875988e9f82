import pytest
from pyspark.sql import functions as F

from tidelog.functions import rules as R
from tidelog.functions import statements as S
from tidelog.functions import types as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("sql,op,table", [
    (" insert into main.\"T\"(a) values(1)", "INSERT", "main.T"), ("UPDATE [t] SET a = 1", "UPDATE", "t"), ("delete\n from t;", "DELETE", "t"),
    ("CREATE TABLE IF NOT EXISTS t(a)", "CREATETABLE", "t"), ("DROP TABLE t;", "DROPTABLE", "t"), ("ALTER TABLE a.b.t1 RENAME TO a.b.t2;", "RENAMETABLE", "a.b.t1"),
    ("ALTER TABLE t ADD COLUMN b TEXT", "ADDCOLUMN", "t"), ("ALTER TABLE t RENAME COLUMN a TO b", "RENAMECOLUMN", "t"), ("ALTER TABLE t DROP COLUMN a", "DROPCOLUMN", "t"),
    ("ALTER TABLE t ALTER a", "ALTERCOLUMN", "t"), ("BEGIN", "BEGINTRAN", None), ("COMMIT", "COMMITTRAN", None), ("ROLLBACK TO s", "ROLLBACKTRAN", None), ("CHECKPOINT", "CHECKPOINTTRAN", None), ("PRAGMA x", "NOOP", None)])
def test_operation_and_table(spark, sql, op, table):
    assert one(spark, S.operation(F.lit(sql))) == op
    assert one(spark, S.table_name(F.lit(sql))) == table


def test_altered(spark):
    assert tuple(one(spark, S.altered(F.lit("ALTER TABLE a.b.t1 RENAME TO a.b.t2;")))) == ("t1", "t2")
    assert tuple(one(spark, S.altered(F.lit("ALTER TABLE t RENAME COLUMN \"a\" TO b")))) == ("a", "b")
    assert tuple(one(spark, S.altered(F.lit("ALTER TABLE t ADD COLUMN c INT")))) == (None, "c")


@pytest.mark.parametrize("sql,store,streaming", [
    ("UPDATE t SET v = ? WHERE id = ?", True, False), ("DELETE FROM t WHERE id = ?", True, False), ("UPDATE t SET v = (SELECT 'x')", False, False),
    ("DELETE FROM t WHERE id IN (SELECT id FROM t)", False, False), ("UPDATE t SET v = lower(?)", False, False), ("INSERT INTO t VALUES(1, 2)", True, True),
    ("INSERT INTO t SELECT * FROM u", False, False), ("INSERT INTO t VALUES (1), (2)", False, False), ("create table t(a)", True, True), ("select 1", True, True), ("", False, False), (None, False, False), ("VACUUM", False, False)])
def test_policy(spark, sql, store, streaming):
    c = F.lit(sql).cast("string")
    assert one(spark, S.allowed(c)) == store and one(spark, S.allowed(c, True)) == streaming


def test_columns_and_widths(spark):
    assert one(spark, S.insert_columns(F.lit("INSERT INTO t (a, \"b\") VALUES (?, ?)"))) == ["a", "b"]
    assert one(spark, S.insert_columns(F.lit("INSERT INTO t VALUES (?, ?)"))) is None
    assert one(spark, S.update_columns(F.lit("UPDATE t SET a = ?, b = b + 1 WHERE c = ?"))) == ["a", "b"]
    assert one(spark, S.where_columns(F.lit("UPDATE t SET a = ? WHERE id >= ? and `k` <> 'x'"))) == ["id", "k"]
    assert one(spark, S.where_columns(F.lit("DELETE FROM t"))) == []
    assert one(spark, S.full_width_insert(F.lit("INSERT INTO t VALUES(?, ?)"), F.lit(2))) and not one(spark, S.full_width_insert(F.lit("INSERT INTO t(a) VALUES(?)"), F.lit(2)))


def test_internal_tables(spark):
    assert one(spark, S.is_internal_table(F.lit("x.\"tidelog_meta\""))) and one(spark, S.is_internal_table(F.lit("dashboard"))) and not one(spark, S.is_internal_table(F.lit("t")))
    assert one(spark, S.is_blocked_table(F.lit("replay_checkpoint"))) and not one(spark, S.is_blocked_table(F.lit("t")))
    assert one(spark, S.is_control(F.lit(" vacuum"), True)) and not one(spark, S.is_control(F.lit(" vacuum")))


def test_create_table():
    table, cols = S.parse_create("CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY, \"n\" VARCHAR(20) NOT NULL DEFAULT 'a,b', p DECIMAL(10, 2), UNIQUE(n), CHECK (p > 0))")
    assert table == "t" and [(c.name, c.type, c.key_place) for c in cols] == [("id", "INTEGER", 1), ("n", "VARCHAR(20)", 0), ("p", "DECIMAL(10, 2)", 0)]
    _, cols = S.parse_create("create table t(a int, b int, c text, primary key (b, a));")
    assert [c.key_place for c in cols] == [2, 1, 0]
    with pytest.raises(ValueError):
        S.parse_create("SELECT 1")


def test_split_and_messages():
    assert S.split_statements("a; b 'x;''y'; -- c;\n d /* ; */ e;; \"q;\" - 1 / 2") == ["a", "b 'x;''y'", "d  e", "\"q;\" - 1 / 2"]
    assert S.split_statements("") == [] and S.split_statements("'open ; ") == ["'open ;"]
    assert [S.transaction_message(x) for x in ("BEGIN x", "end", "Commit;", "rollback", "select")] == ["begin", "commit", "commit", "rollback", None]


def test_literals_and_texts():
    assert [S.literal(v) for v in (None, 3, 1.5, float("nan"), float("-inf"), "o'x", b"\xff", True)] == ["NULL", "3", "1.5", "NULL", "NULL", "'o''x'", "X'ff'", "1"]
    assert S.bind("a = ? and b = '?' and c = ? or ?", [1, "x"]) == "a = 1 and b = '?' and c = 'x' or NULL"
    assert S.event_sql("UPDATE", "t", ["a", "b"]) == 'UPDATE "t" SET "a" = ?, "b" = ? WHERE "a" = ? AND "b" = ?'
    assert S.prefix_values("INSERT INTO t VALUES (?)", 2) == "INSERT INTO t VALUES (?, ?, ?)"
    assert S.qualify("t", "c", "s") == '"c"."s"."t"' and S.quote('a"b') == '"a""b"' and S.qualify("t", quoted=False) == "t"


@pytest.mark.parametrize("declared,duckdb,postgres", [
    ("INTEGER", "bigint", "bigint"), ("varchar(20)", "text", "text"), ("DECIMAL(10,2)", "double", "double precision"), ("Blob", "blob", "bytea"), ("date", "timestamp", "timestamp"),
    ("uuid", "text", "text"), ("integer[]", "text", "integer[]"), ("boolean", "boolean", "boolean"), ("", "text", "TEXT")])
def test_types(spark, declared, duckdb, postgres):
    assert T.map_type(declared, "duckdb") == duckdb and T.map_type(declared, "postgres") == postgres and T.map_type(declared or "x", "sqlite") == (declared or "x")
    assert one(spark, T.mapped(F.lit(declared), "duckdb")) == duckdb and one(spark, T.mapped(F.lit(declared), "postgres")) == postgres


def test_type_modes():
    assert T.map_type("BLOB", "postgres", "ALL_TEXT") == "BYTEA" and T.map_type("int", "duckdb", "ALL_TEXT") == "text" and T.map_type("Weird(1)", "duckdb", "EXACT") == "Weird(1)"
    own = {"int": "NUMBER", "varchar(length)": "nvarchar(length)", "decimal(precision,scale)": "money"}
    assert T.map_type("INT", "duckdb", "CUSTOMIZED", own) == "NUMBER" and T.map_type("VARCHAR(7)", "duckdb", "CUSTOMIZED", own) == "nvarchar(7)"
    assert T.map_type("decimal(1,2)", "duckdb", "CUSTOMIZED", own) == "money" and T.map_type("text", "duckdb", "CUSTOMIZED", own) == "text"
    assert T.map_type("float[3]", "postgres", vectors=True) == "VECTOR" and T.map_type("text[]", "postgres", vectors=True) == "text[]"


def test_cells(spark):
    assert [one(spark, T.cell_text(F.lit(v), k)) for v, k in ((1.0, "double"), (1e20, "double"), (1.25, "double"), (bytearray(b"\xab"), "binary"), (True, "boolean"), ("x", "string"))] == ["1", "100000000000000000000", "1.25", "AB", "1", "x"]
    assert one(spark, T.cell_text(F.lit(None).cast("double"), "double")) == "null"
    assert one(spark, T.typed(F.lit("7x"), "INTEGER")) is None and one(spark, T.typed(F.lit("7"), "INTEGER")) == 7 and one(spark, T.typed(F.lit("FF"), "BLOB")) == bytearray(b"\xff")


def test_filter_rules(spark):
    rules = R.FilterRules.parse("# c\nallowed = true\nblocked=false\norig = renamed\nallowed.secret = false\nallowed.v = w\n")
    assert [rules.table(t) for t in ("Allowed", "blocked", "ORIG", "other")] == ["Allowed", None, "renamed", None]
    assert [rules.column("allowed", c) for c in ("id", "SECRET", "V")] == ["id", None, "w"] and rules.column("orig", "x") == "x"
    df = spark.createDataFrame([(1, "a", "s")], "id int, v string, secret string")
    assert rules.project(df, "allowed").columns == ["id", "w"] and rules.project(df, "blocked") is None
    assert R.FilterRules.parse("t.a=false", True, False).project(df.select("id"), "t") is None
    assert [r.x for r in spark.createDataFrame([("allowed",), ("blocked",), ("Orig",), ("z",)], "t string").select(rules.table_expression(F.col("t")).alias("x")).collect()] == ["allowed", None, "renamed", None]
    with pytest.raises(ValueError):
        R.FilterRules.parse("a.b.c = true")
    with pytest.raises(ValueError):
        R.FilterRules.parse("nothing")


def test_value_map(spark):
    values = R.ValueMap.parse('{"t.name": {"alice": "AA", "bob": "BB", "null": "none"}, "t.n": {"1": "one"}}')
    df = spark.createDataFrame([("alice", 1.0), ("bob  ", 2.0), ("charlie", None), (None, 1.5)], "name string, n double")
    assert [tuple(r) for r in values.project(df, "T").collect()] == [("AA", "one"), ("BB", "2"), ("charlie", None), ("none", "1.5")]


def test_small_rules(spark):
    assert R.selected_tables(["a", "B", "c"], ["A", "b"], ["B"]) == ["a"] and R.selected_tables(["a"]) == ["a"]
    assert one(spark, R.update_text(F.lit(1_700_000_000_123))) == "2023-11-14 22:13:20"
    assert one(spark, R.mapper_of("REPLICATION", F.lit(True))) == "CONSOLIDATION" and one(spark, R.mapper_of("REPLICATION", F.lit(False))) == "REPLICATION"
    assert R.INIT_MODES["TRY_CREATE_APPEND_DATA"] == (True, False)
