"""Registered queries of the log engine, each with DuckDB SQL that says the same in other words.

The log is derived from events: device user_id % 4, segments of 500 events, transactions of 5;
signup inserts, error deletes, anything else updates the row of user_id. Of ten transactions one
is rolled back and one never decided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import rules as R
from tidelog.functions import statements as S
from tidelog.functions import types as T
from tidelog.operators import apply as A
from tidelog.operators import control as C
from tidelog.operators import joins as J
from tidelog.operators import log as L
from tidelog.operators import stats as G
from tidelog.plans import registry as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPDATED = "2024-01-01 00:00:00"
INSERT = "INSERT INTO accounts(id, kind, amount) VALUES(?, ?, ?)"
UPDATE = "UPDATE accounts SET kind = ?, amount = ? WHERE id = ?"
DELETE = "DELETE FROM accounts WHERE id = ?"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change an event, without markers; sql of a run of equal statements only once."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    rows = e.select(
        F.concat(F.lit("dev"), (F.col("user_id") % 4).cast("string")).alias("device_id"), F.floor(F.col("event_id") / 500).alias("segment_seq"),
        ((F.col("event_id") % 500) * 10).alias("change_number"), F.floor(F.col("event_id") / 5).alias("commit_id"), op.alias("op"),
        F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), "ts")
    full = F.when(F.col("op") == "INSERT", INSERT).when(F.col("op") == "DELETE", DELETE).otherwise(UPDATE)
    before = F.lag("op").over(Window.partitionBy("device_id", "segment_seq").orderBy("change_number"))
    return rows.withColumn("sql", F.when(before.eqNullSafe(F.col("op")), F.lit(None)).otherwise(full))


def marked(rows: DataFrame) -> DataFrame:
    """The rows and each transaction's marker after its last change."""
    last = rows.groupBy("device_id", "segment_seq", "commit_id").agg((F.max("change_number") + 5).alias("change_number"))
    fate = F.when(F.col("commit_id") % 10 == 0, "ROLLBACK").when(F.col("commit_id") % 10 != 1, "COMMIT")
    return rows.unionByName(last.withColumn("sql", fate).where("sql is not null"), allowMissingColumns=True)


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(bodies(spark, sf_dir))


BODY = f"""body as (select 'dev' || (user_id % 4) as device_id, event_id // 500 as segment_seq, (event_id % 500) * 10 as change_number, event_id // 5 as commit_id,
 case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as op, user_id as id, event_type as kind, value as amount, ts from events),
texted as (select *, case op when 'INSERT' then '{INSERT}' when 'DELETE' then '{DELETE}' else '{UPDATE}' end as full_sql from body),
good as (select * from body where commit_id % 10 not in (0, 1))"""

MARKS = """marks as (select device_id, segment_seq, max(change_number) + 5 as change_number, commit_id, case commit_id % 10 when 0 then 'ROLLBACK' else 'COMMIT' end as sql
 from body where commit_id % 10 <> 1 group by device_id, segment_seq, commit_id)"""


# --- log algebra ---------------------------------------------------------------------------------


@query(f"with {BODY} select device_id, segment_seq, change_number, commit_id, full_sql as sql from texted")
def sql_carry_forward(spark, sf_dir):
    return L.carry_forward(bodies(spark, sf_dir)).select("device_id", "segment_seq", "change_number", "commit_id", "sql")


@query(f"""with {BODY}, x as (select *, nullif(case when change_number % 30 = 0 then '' when change_number % 20 = 0 then null else full_sql end, '') as s from texted)
select device_id, segment_seq, change_number, coalesce(last_value(s ignore nulls) over (partition by device_id, segment_seq order by change_number), '') as sql from x""")
def sql_carry_forward_changes(spark, sf_dir):
    full = L.carry_forward(bodies(spark, sf_dir))
    holes = full.withColumn("sql", F.when(F.col("change_number") % 30 == 0, "").when(F.col("change_number") % 20 == 0, F.lit(None)).otherwise(F.col("sql")))
    return L.carry_forward(holes, changes=True).select("device_id", "segment_seq", "change_number", "sql")


@query(f"with {BODY} select distinct device_id, segment_seq, commit_id, case commit_id % 10 when 0 then 'Rollback' when 1 then 'Unknown' else 'Commit' end as fate from body")
def txn_fates(spark, sf_dir):
    return L.fates(logged(spark, sf_dir))


@query(f"with {BODY}, {MARKS} select device_id, segment_seq, change_number, commit_id, op from good union all select device_id, segment_seq, change_number, commit_id, null from marks where sql = 'COMMIT'")
def committed_changes(spark, sf_dir):
    return L.committed(logged(spark, sf_dir)).select("device_id", "segment_seq", "change_number", "commit_id", "op")


@query(f"with {BODY} select device_id, segment_seq, max(commit_id) as max_commit_id from good group by all")
def max_committed_commit(spark, sf_dir):
    return L.max_committed(logged(spark, sf_dir)).where("max_commit_id is not null")


@query("""select 'dev' || (o_custkey % 4) as device_id, o_orderkey // 1000 as segment_seq, o_orderkey as commit_id, (o_orderkey % 1000) * 10 as change_number, l_linenumber as ordinal,
 'INSERT INTO items VALUES(' || l_partkey || ')' as sql, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all""")
def sidecar_expand(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dealt, lines = L.dealt((orders, ["o_orderkey"]), (lines, ["l_orderkey"]))
    at = [F.concat(F.lit("dev"), (F.col("o_custkey") % 4).cast("string")).alias("device_id"), F.floor(F.col("o_orderkey") / 1000).alias("segment_seq"), F.col("o_orderkey").alias("commit_id")]
    same = F.col("l_orderkey") == F.col("o_orderkey")
    inner = lines.join(dealt, same).select(*at, F.col("l_linenumber").alias("change_number"), F.concat(F.lit("INSERT INTO items VALUES("), F.col("l_partkey").cast("string"), F.lit(")")).alias("sql"))
    control = orders.join(lines, same, "left_semi").select(*at).where("device_id is not null")  # a join by device meets no null
    inner = inner.unionByName(control.select("*", F.lit(0).alias("change_number"), F.lit("BEGIN").alias("sql")))
    outer = control.select("*", ((F.col("commit_id") % 1000) * 10).alias("change_number"), F.lit("REPLAY_TXN").alias("sql"))
    return L.expand_sidecars(outer, inner).groupBy("device_id", "segment_seq", "commit_id", "change_number", "ordinal", "sql").agg(F.count("*").alias("n"))


@query(f"with {BODY}, l as (select device_id, segment_seq, max(commit_id) as c from body group by all) select device_id, segment_seq from l where c % 10 <> 1")
def segment_fate_gate(spark, sf_dir):
    return L.decided_segments(logged(spark, sf_dir))


_CHECKPOINT = "(values ('dev0', 3, 4990), ('dev1', 7, 1200), ('dev2', 5, -1)) as c(device_id, resume_seq, resume_change)"


def _checkpoint(spark):
    return spark.createDataFrame([("dev0", 3, 4990), ("dev1", 7, 1200), ("dev2", 5, -1)], "device_id string, resume_seq long, resume_change long")


@query(f"""with {BODY}, l as (select device_id, segment_seq, max(change_number) as m from body group by all),
kept as (select l.device_id, l.segment_seq from l left join {_CHECKPOINT} on c.device_id = l.device_id where resume_seq is null or not (resume_seq > segment_seq or resume_seq = segment_seq and resume_change >= m))
select device_id, segment_seq, count(*) as n from body semi join kept using (device_id, segment_seq) group by all""")
def segment_skip(spark, sf_dir):
    return L.skip_segments(bodies(spark, sf_dir), _checkpoint(spark)).groupBy("device_id", "segment_seq").agg(F.count("*").alias("n"))


@query(f"""with {BODY} select b.device_id, b.segment_seq, b.change_number from body b left join {_CHECKPOINT} on c.device_id = b.device_id
where not coalesce(resume_change >= 0 and segment_seq = resume_seq and change_number <= resume_change, false)""")
def resume_filter(spark, sf_dir):
    return L.resume(bodies(spark, sf_dir), _checkpoint(spark)).select("device_id", "segment_seq", "change_number")


@query(f"""with {BODY}, c(device_id, s, k) as (values ('dev0', 3, 333), ('dev3', 9, 950)) select b.device_id, b.segment_seq, b.commit_id, count(*) as n from body b left join c using (device_id)
where s is null or segment_seq > s or segment_seq = s and commit_id > k group by all""")
def replica_resume(spark, sf_dir):
    at = spark.createDataFrame([("dev0", 3, 333), ("dev3", 9, 950)], "device_id string, resume_seq long, resume_commit long")
    return L.resume_replica(bodies(spark, sf_dir), at).groupBy("device_id", "segment_seq", "commit_id").agg(F.count("*").alias("n"))


def _argued(spark, sf_dir):
    old = F.array(F.col("id").cast("string"), F.lit("old"))
    new = F.array(F.col("id").cast("string"), F.col("kind"))
    return bodies(spark, sf_dir).withColumn("args", F.when(F.col("op") == "UPDATE", F.concat(old, new)).when(F.col("op") == "INSERT", new).otherwise(old))


@query(f"""with {BODY} select device_id, segment_seq, change_number, case when op <> 'INSERT' then id || ',old' end as before, case when op <> 'DELETE' then id || ',' || kind end as after from body""")
def before_after_split(spark, sf_dir):
    return L.images(_argued(spark, sf_dir)).select("device_id", "segment_seq", "change_number", F.when(F.col("before").isNotNull(), F.array_join("before", ",")).alias("before"), F.when(F.col("after").isNotNull(), F.array_join("after", ",")).alias("after"))


@query(f"with {BODY} select device_id, segment_seq, change_number, case op when 'UPDATE' then id || ',' || kind || ',' || id || ',old' when 'INSERT' then id || ',' || kind else id || ',old' end as args from body")
def apply_argument_order(spark, sf_dir):
    return L.apply_order(_argued(spark, sf_dir)).select("device_id", "segment_seq", "change_number", F.array_join("args", ",").alias("args"))


@query(f"with {BODY} select device_id, segment_seq, change_number, op from body where op = 'DELETE' and id % 2 = 0")
def image_width_quarantine(spark, sf_dir):
    rows = _argued(spark, sf_dir).withColumn("table_name", F.lit("accounts"))
    broken = rows.withColumn("args", F.when((F.col("op") == "DELETE") & (F.col("id") % 2 == 0), F.slice("args", 1, 1)).otherwise(F.col("args")))
    return L.bad_widths(broken, spark.createDataFrame([("accounts", 2)], "table_name string, width int")).select("device_id", "segment_seq", "change_number", "op")


@query("""with s as (select c_custkey as k, 'd' || c_custkey as device_id, 100 * (c_custkey % 5 > 0)::int + c_custkey % 3 as m, case when c_custkey % 2 = 0 then 'SQLITE' else 'DUCKDB' end as t from customer),
l as (select k, device_id, m, t, 100 * (k % 7 > 0)::int + k % 4 as l, case k % 3 when 0 then 'Commit' when 1 then 'Rollback' else 'Unknown' end as f from s)
select device_id, m as source_commit, l as log_commit, f as fate, case when m = 0 or l = 0 then 'none' when l < m then 'error'
 when l > m then case f when 'Commit' then 'error' when 'Unknown' then case t when 'SQLITE' then 'append ROLLBACK' else 'remove commit' end else 'none' end
 when f = 'Rollback' then 'error' when f = 'Unknown' then 'append COMMIT' else 'none' end as action from l""")
def in_doubt_resolution(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k, F.concat(F.lit("d"), k.cast("string")).alias("device_id"))
    sources = c.select("device_id", (100 * (k % 5 > 0).cast("long") + k % 3).alias("source_commit"), F.when(k % 2 == 0, "SQLITE").otherwise("DUCKDB").alias("device_type"))
    logs = c.select("device_id", (100 * (k % 7 > 0).cast("long") + k % 4).alias("log_commit"), F.when(k % 3 == 0, "Commit").when(k % 3 == 1, "Rollback").otherwise("Unknown").alias("fate"))
    return L.resolve_in_doubt(sources, logs).select("device_id", "source_commit", "log_commit", "fate", "action")


@query(f"""with {BODY}, c as (select device_id, commit_id, count(*) as n from body group by all),
s as (select device_id, commit_id, coalesce(sum(n) over (partition by device_id order by commit_id rows between unbounded preceding and 1 preceding), 0)::bigint // 200 as segment_seq from c)
select device_id, segment_seq, count(*) as n, min(commit_id) as first_commit from s join body using (device_id, commit_id) group by device_id, s.segment_seq""".replace("select device_id, segment_seq, count", "select device_id, s.segment_seq, count"))
def segment_rotation(spark, sf_dir):
    out = L.rotate(bodies(spark, sf_dir), 200)
    return out.groupBy("device_id", "segment_seq").agg(F.count("*").alias("n"), F.min("commit_id").alias("first_commit"))


@query("""with e as (select 'dev' || (user_id % 4) as device_id, event_id, epoch_ms(ts) // 100000 as clock_ms from events),
r as (select *, row_number() over (partition by device_id order by event_id) as rn from e)
select device_id, event_id, max(clock_ms - rn) over (partition by device_id order by event_id) + rn as commit_id from r""")
def monotonic_commit_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("dev"), (F.col("user_id") % 4).cast("string")).alias("device_id"), "event_id", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 100000).alias("clock_ms"))
    return L.monotonic_commit_ids(e, order=["event_id"]).select("device_id", "event_id", "commit_id")


@query(f"""with {BODY}, r as (select *, case when lag(op) over w = op then 0 else 1 end as fresh from body window w as (partition by device_id, segment_seq order by change_number)),
g as (select *, sum(fresh) over (partition by device_id, segment_seq order by change_number) as run from r),
n as (select *, row_number() over (partition by device_id, segment_seq, run order by change_number) - 1 as i from g),
b as (select *, i // case op when 'UPDATE' then 3 else 1000 end as cut, i % case op when 'UPDATE' then 3 else 1000 end as place from n)
select device_id, segment_seq, change_number, dense_rank() over (partition by device_id, segment_seq order by run, cut) as batch_id, place from b""")
def batch_groups(spark, sf_dir):
    rows = bodies(spark, sf_dir).withColumns({"kind": F.col("op"), "table_name": F.lit("accounts"), "sql": F.col("op")})
    out = L.operation_batches(rows, {"UPDATE": 3})
    return out.select("device_id", "segment_seq", "change_number", F.col("batch_id").cast("long"), F.col("place").cast("long"))


# --- statements ----------------------------------------------------------------------------------

_TEXTS = """texts as (select event_id, case event_id % 16
 when 0 then 'INSERT INTO main.T' || user_id || '(a, "b") VALUES(?, ?)' when 1 then '  update "t_' || user_id || '" set a = ?, b = 2 where c = ? and d >= 1'
 when 2 then 'DELETE FROM t' || user_id || ' WHERE id = ?' when 3 then 'CREATE TABLE IF NOT EXISTS t' || user_id || '(a INT)' when 4 then 'DROP TABLE IF EXISTS t' || user_id || ';'
 when 5 then 'ALTER TABLE t' || user_id || ' RENAME TO u' || user_id when 6 then 'alter table t ADD COLUMN c' || user_id || ' TEXT' when 7 then 'ALTER TABLE t DROP COLUMN c'
 when 8 then 'ALTER TABLE t RENAME COLUMN a TO b' || user_id when 9 then 'ALTER TABLE t ALTER COLUMN a TYPE INT' when 10 then 'BEGIN' when 11 then 'commit;' when 12 then 'ROLLBACK TO x'
 when 13 then 'UPDATE t SET a = lower(b)' when 14 then 'INSERT INTO t SELECT * FROM u' else 'SELECT 1' end as sql from events)"""


def _texts(spark, sf_dir):
    return spark.sql("with " + _TEXTS.replace("from events", "from {events}") + " select * from texts", events=read(spark, sf_dir, "events"))


@query(f"""with {_TEXTS} select event_id, case event_id % 16 when 0 then 'INSERT' when 1 then 'UPDATE' when 2 then 'DELETE' when 3 then 'CREATETABLE' when 4 then 'DROPTABLE' when 5 then 'RENAMETABLE' when 6 then 'ADDCOLUMN'
 when 7 then 'DROPCOLUMN' when 8 then 'RENAMECOLUMN' when 9 then 'ALTERCOLUMN' when 10 then 'BEGINTRAN' when 11 then 'COMMITTRAN' when 12 then 'ROLLBACKTRAN' when 13 then 'UPDATE' when 14 then 'INSERT' else 'NOOP' end as op,
 case event_id % 16 when 0 then 'INSERT' when 1 then 'UPDATE' when 2 then 'DELETE' when 13 then 'UPDATE' when 14 then 'INSERT' else 'OTHER' end as kind from texts""")
def op_type_classify(spark, sf_dir):
    return _texts(spark, sf_dir).select("event_id", S.operation(F.col("sql")).alias("op"), S.dml_kind(F.col("sql")).alias("kind"))


@query(f"""with {_TEXTS} select event_id, case event_id % 16 when 0 then 'main.T' || user_id when 1 then 't_' || user_id when 2 then 't' || user_id when 3 then 't' || user_id when 4 then 't' || user_id
 when 5 then 't' || user_id when 6 then 't' when 7 then 't' when 8 then 't' when 9 then 't' when 13 then 't' when 14 then 't' end as table_name from texts join events using (event_id)""")
def table_name_extract(spark, sf_dir):
    return _texts(spark, sf_dir).select("event_id", S.table_name(F.col("sql")).alias("table_name"))


@query(f"""with {_TEXTS} select event_id, case event_id % 16 when 0 then 'a,b' end as insert_columns, case event_id % 16 when 1 then 'a,b' when 13 then 'a' end as update_columns, case event_id % 16 when 1 then 'c,d' when 2 then 'id' else '' end as where_columns from texts""")
def statement_columns(spark, sf_dir):
    c = F.col("sql")
    return _texts(spark, sf_dir).select("event_id", _joined(S.insert_columns(c)).alias("insert_columns"), _joined(S.update_columns(c)).alias("update_columns"), _joined(S.where_columns(c)).alias("where_columns"))


def _joined(a):
    return F.when(a.isNotNull(), F.array_join(a, ","))


@query(f"""with {_TEXTS} select event_id, case event_id % 16 when 5 then 't' || user_id when 7 then 'c' when 8 then 'a' end as old_name, case event_id % 16 when 5 then 'u' || user_id when 6 then 'c' || user_id when 8 then 'b' || user_id end as new_name
from texts join events using (event_id)""")
def alter_names(spark, sf_dir):
    return _texts(spark, sf_dir).select("event_id", S.altered(F.col("sql")).alias("a")).select("event_id", "a.old_name", "a.new_name")


@query(f"with {_TEXTS} select event_id, event_id % 16 in (0, 2, 3, 4, 5, 6, 7, 8, 9, 15) as store, event_id % 16 in (0, 3, 4, 5, 6, 7, 8, 9, 15) as streaming, event_id % 16 in (10, 11, 12) as control from texts".replace("event_id % 16 in (0, 2, 3", "event_id % 16 in (0, 2, 3"))
def policy_check(spark, sf_dir):
    c = F.col("sql")
    rows = _texts(spark, sf_dir).withColumn("sql", F.when(F.col("event_id") % 16 == 1, F.lit("UPDATE \"t\" SET a = 1")).otherwise(F.col("sql")))
    return rows.select("event_id", S.allowed(c).alias("store"), S.allowed(c, streaming=True).alias("streaming"), S.is_control(c).alias("control"))


# --- mapping -------------------------------------------------------------------------------------

_FILTER = "accounts = true\nview = false\nclick = clicks\npurchase = true\nsignup.value = false\nclick.kind = what\nclick.amount = false"


@query("select event_id, case event_type when 'click' then 'clicks' else event_type end as table_name from events where event_type in ('click', 'purchase')")
def filter_mapper_tables(spark, sf_dir):
    rules = R.FilterRules.parse(_FILTER)
    return read(spark, sf_dir, "events").select("event_id", rules.table_expression(F.col("event_type")).alias("table_name")).where("table_name is not null")


@query(f"""with {BODY} select device_id, segment_seq, change_number, case kind when 'click' then 'what=click' else 'amount=' || floor(amount)::bigint || ',kind=' || kind end as image from body""")
def filter_mapper_columns(spark, sf_dir):
    image = F.create_map(F.lit("amount"), F.col("amount").cast("bigint").cast("string"), F.lit("kind"), F.col("kind"))
    rules = R.FilterRules.parse(_FILTER)
    rows = bodies(spark, sf_dir).withColumn("amount", F.floor("amount"))
    kept = rules.image(F.col("kind"), image)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("device_id", "segment_seq", "change_number", text.alias("image"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'FINISHED' when 'O' then 'OPEN' else o_orderstatus end as o_orderstatus, case trim(o_orderpriority) when '1-URGENT' then 'high' else o_orderpriority end as o_orderpriority from orders")
def value_mapper(spark, sf_dir):
    values = R.ValueMap.parse('{"orders.o_orderstatus": {"F": "FINISHED", "O": "OPEN"}, "ORDERS.O_ORDERPRIORITY": {"1-URGENT": "high"}}')
    return values.project(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "orders")


_TYPES = ("INTEGER", "varchar(20)", "DECIMAL(10,2)", "Blob", "timestamp with time zone", "uuid", "integer[]", "float[3]", "BOOLEAN", "double precision", "", "vector(3)", "jsonb[]", "hugeint")


@query("with t as (select p_partkey, case p_partkey % 14 " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(_TYPES)) + """ end as declared from part)
select p_partkey, case p_partkey % 14 when 0 then 'bigint' when 2 then 'double' when 3 then 'blob' when 4 then 'timestamp' when 8 then 'boolean' when 9 then 'double' else 'text' end as duckdb,
 case p_partkey % 14 when 0 then 'bigint' when 2 then 'double precision' when 3 then 'bytea' when 4 then 'timestamp' when 6 then declared when 7 then declared when 8 then 'boolean' when 9 then 'double precision' when 10 then 'TEXT' when 11 then declared when 12 then declared else 'text' end as postgres, declared as sqlite from t""")
def type_mapper(spark, sf_dir):
    names = F.array(*map(F.lit, _TYPES))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 14).cast("int")).alias("declared"))
    return rows.select("p_partkey", *(T.mapped(F.col("declared"), d).alias(d) for d in ("duckdb", "postgres", "sqlite")))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated from events")
def update_timestamp_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", R.update_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("updated"))


def _device_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    a = R.tag(o.where("o_custkey % 2 = 0"), "d0", "even", UPDATED)
    b = R.tag(o.where("o_custkey % 2 = 1").select("o_totalprice", "o_orderkey"), "d1", "odd", UPDATED)
    return [a, b]


@query(f"select case o_custkey % 2 when 0 then 'd0' else 'd1' end as src_device_id, case o_custkey % 2 when 0 then 'even' else 'odd' end as src_device_name, '{UPDATED}' as src_update_ts, o_orderkey, case o_custkey % 2 when 0 then o_custkey end as o_custkey, o_totalprice from orders")
def consolidated_orders(spark, sf_dir):
    return A.fan_in(_device_orders(spark, sf_dir))


# --- apply ---------------------------------------------------------------------------------------

_LATEST = f"""with {BODY}, r as (select *, row_number() over (partition by device_id, id order by segment_seq desc, change_number desc) as rn from good)"""


@query(f"{_LATEST} select device_id, id, kind, amount from r where rn = 1 and op <> 'DELETE'")
def cdc_apply_latest(spark, sf_dir):
    """Flagship: log to fates to committed changes to live rows by device and key."""
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    rows = good.select("device_id", "id", "segment_seq", "change_number", "kind", "amount", (F.col("op") == "DELETE").alias("deleted"))
    return A.keyed_apply(rows, ["device_id", "id"])


@query(f"""{_LATEST} select device_id, id, kind, amount from r where rn = 1 and op <> 'DELETE'""")
def keyed_apply_incremental(spark, sf_dir):
    """The same in two steps: the first segments' state, then the rest on top of it."""
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    rows = good.select("device_id", "id", "segment_seq", "change_number", "kind", "amount", (F.col("op") == "DELETE").alias("deleted"))
    half = A.keyed_apply(rows.where("segment_seq < 10"), ["device_id", "id"])
    return A.keyed_apply(rows.where("segment_seq >= 10"), ["device_id", "id"], state=half)


@query(f"""with {BODY}, r as (select *, row_number() over (partition by device_id, id order by segment_seq, change_number) as rn from good) select device_id, id, kind, amount from r where rn = 1""")
def upsert_insert_only(spark, sf_dir):
    good = L.committed(logged(spark, sf_dir)).where("op is not null").select("device_id", "id", "segment_seq", "change_number", "kind", "amount")
    return A.insert_only(good, ["device_id", "id"])


@query(f"""with {BODY}, e as (select device_id, id // 2 as id, segment_seq, change_number, 0 as o, true as gone, null as kind from good where op <> 'INSERT'
 union all select device_id, id // 3, segment_seq, change_number, 1, false, kind from good where op <> 'DELETE'),
r as (select *, row_number() over (partition by device_id, id order by segment_seq desc, change_number desc, o desc) as rn from e)
select device_id, id, kind from r where rn = 1 and not gone""")
def keyed_apply_moving_keys(spark, sf_dir):
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    before = F.when(F.col("op") != "INSERT", F.struct(F.floor(F.col("id") / 2).alias("id"), F.lit("old").alias("kind")))
    after = F.when(F.col("op") != "DELETE", F.struct(F.floor(F.col("id") / 3).alias("id"), F.col("kind").alias("kind")))
    rows = good.select("device_id", "segment_seq", "change_number", before.alias("before"), after.alias("after"))
    return A.keyed_apply(A.signed(rows, ["id"], ["kind"]), ["device_id", "id"], ["segment_seq", "change_number", "ordinal"])


@query()
def bag_apply_small(spark, sf_dir):
    """Images without a key: an order dependent fold, tested against a plain one."""
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    image = F.array(F.col("kind"), F.floor("amount").cast("string"))
    old = F.array(F.lit("view"), F.floor("amount").cast("string"))
    rows = good.select("device_id", "segment_seq", "change_number", "op", F.when(F.col("op") != "INSERT", old).alias("before"), F.when(F.col("op") != "DELETE", image).alias("after"))
    return A.bag_apply(rows, ["device_id"]).select("device_id", F.array_join("image", ",").alias("image"), "copies")


@query(f"""{_LATEST} select device_id, id, kind, amount from r where rn = 1 and op <> 'DELETE'""")
def keyed_merge_out_of_order(spark, sf_dir):
    """Segments that come late, and come again: the state keeps its order, so that no older change overwrites a newer one."""
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    rows = good.select("device_id", "id", "segment_seq", "change_number", "kind", "amount", (F.col("op") == "DELETE").alias("deleted"))
    state = None
    for part in ("segment_seq % 3 = 2", "segment_seq % 3 = 0", "segment_seq % 3 = 1", "segment_seq % 3 = 0"):
        state = A.keyed_merge(rows.where(part), ["device_id", "id"], state)
    return A.live(state)


@query(f"""with {BODY}, e as (select device_id, segment_seq, change_number, op, kind || ',' || floor(amount)::bigint as image from good where op <> 'UPDATE'
 union all select device_id, segment_seq, change_number, 'DELETE', 'view,' || floor(amount)::bigint from good where op = 'UPDATE'),
d as (select device_id, image, max((segment_seq, change_number)) as last from e where op = 'DELETE' group by all)
select e.device_id, e.image, count(*) as copies from e left join d using (device_id, image) where op = 'INSERT' and (last is null or (e.segment_seq, e.change_number) > last) group by all""")
def bag_apply_inserts_deletes(spark, sf_dir):
    """Images without a key where none is updated: what was inserted after an image's last delete stays."""
    good = L.committed(logged(spark, sf_dir)).where("op is not null")
    gone = F.when(F.col("op") == "UPDATE", "view").otherwise(F.col("kind"))
    image = F.array(gone, F.floor("amount").cast("string"))
    rows = good.select("device_id", "segment_seq", "change_number", F.when(F.col("op") == "INSERT", "INSERT").otherwise("DELETE").alias("op"), F.when(F.col("op") != "INSERT", image).alias("before"), F.when(F.col("op") == "INSERT", image).alias("after"))
    return A.bag_apply(rows, ["device_id"]).select("device_id", F.array_join("image", ",").alias("image"), "copies")


@query("""select c_custkey, case when c_nationkey in (1, 2, 3) or c_mktsegment ilike 'auto%' then upper(c_name) || ', it''s' else c_name end as c_name,
 case when c_acctbal between -100 and 1000 and not (c_nationkey = 7 or c_nationkey is null) then abs(c_acctbal) * 2 + 1 else c_acctbal end as c_acctbal from customer
 where not (c_custkey % 10 = 4 and (c_acctbal > 9000 or c_mktsegment = 'BUILDING')) union all select * from (values (-1, 'a, b; WHERE c', 0.5::double), (-2, null, null))""")
def predicate_apply_conditions(spark, sf_dir):
    """OR, IN, BETWEEN, LIKE, IS NULL, functions, commas and key words in literals, several rows of values."""
    rows = read(spark, sf_dir, "customer")
    done = A.apply_statements(rows, [
        ("DELETE FROM customer WHERE c_custkey % 10 = ? AND (c_acctbal > 9000 OR c_mktsegment = 'BUILDING')", [4]),
        ("UPDATE customer SET c_name = upper(\"c_name\") || ', it''s' WHERE c_nationkey IN (1, ?, 3) OR c_mktsegment LIKE 'auto%'", [2]),
        ("UPDATE customer SET c_acctbal = abs(c_acctbal) * 2 + 1 WHERE c_acctbal BETWEEN ? AND 1000 AND NOT (c_nationkey = 7 OR c_nationkey IS NULL)", [-100]),
        ("INSERT INTO customer(c_custkey, c_name, c_acctbal) VALUES (-1, 'a, b; WHERE c', ?), (-2, NULL, NULL)", [0.5]),
    ])
    return done.select("c_custkey", "c_name", "c_acctbal")


@query("select c_custkey, c_name, case when c_mktsegment = 'BUILDING' and c_acctbal < 0 then c_acctbal + 100 else c_acctbal end as c_acctbal from customer where not (c_nationkey = 3 and c_acctbal > 5000)")
def predicate_apply(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    done = A.apply_statements(rows, [("DELETE FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", [3, 5000.0]), ("UPDATE customer SET c_acctbal = c_acctbal + ? WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0", [100.0])])
    return done.select("c_custkey", "c_name", "c_acctbal")


@query("select 'UPDATE' as op, s_suppkey as before_key, s_suppkey + 10 as after_key from supplier where s_nationkey > 12 union all select 'DELETE', s_suppkey, null from supplier where s_nationkey = 5")
def statement_row_images(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = A.statement_images(rows, "UPDATE supplier SET s_suppkey = s_suppkey + 10 WHERE s_nationkey > ?", [12])
    out = out.unionByName(A.statement_images(rows, "DELETE FROM supplier WHERE s_nationkey = 5"))
    return out.select("op", F.col("before.s_suppkey").alias("before_key"), F.col("after.s_suppkey").alias("after_key"))


@query("select 'lake' as destination, o_orderkey, o_orderstatus as status from orders where o_orderstatus <> 'P' union all select 'mart', o_orderkey, case o_orderstatus when 'F' then 'done' else o_orderstatus end from orders")
def fan_out_two_destinations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    mart = R.ValueMap.parse('{"orders.o_orderstatus": {"F": "done"}}')
    keep = R.FilterRules.parse("orders = true\norders.o_orderstatus = status")
    out = A.fan_out(orders, {"lake": lambda d: keep.project(d.where("o_orderstatus <> 'P'"), "orders"), "mart": lambda d: keep.project(mart.project(d, "orders"), "orders"), "none": lambda d: R.FilterRules().project(d, "orders")})
    return A.fan_in([d.select(F.lit(n).alias("destination"), "*") for n, d in out.items()])


@query("select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, case when event_type = 'view' then null else 1 end as flag from events")
def unparsable_values(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_type") == "view", "x").otherwise("1").alias("flag"))
    return A.unparsable(rows, {"k": "int", "flag": "int"})


_ERRORS = ("database is locked", "syntax error near x", "UNIQUE constraint failed", "connection reset pg[235]", "timeout", "no such table: t", "table t already exists", "other")


@query("with e as (select event_id, event_id % 8 as k from events) select event_id, k in (0, 3, 4) as retriable, k in (0, 4) as retriable_on_server, k in (5, 6) as benign from e")
def error_classification(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 8).cast("int")).alias("m"))
    return rows.select("event_id", A.retriable(F.col("m")).alias("retriable"), A.retriable(F.col("m"), F.lit("postgres")).alias("retriable_on_server"), A.benign_ddl(F.col("m")).alias("benign"))


# --- checkpoints and frontiers -------------------------------------------------------------------


@query(f"""with {BODY} select device_id, max(commit_id) as commit_id, max_by(change_number, (segment_seq, change_number)) as change_number, max(segment_seq) as segment_seq, (count(*) + 7)::bigint as txn_count from body group by all""")
def checkpoint_merge(spark, sf_dir):
    rows = bodies(spark, sf_dir)
    applied = rows.groupBy("device_id", "segment_seq").agg(F.max("commit_id").alias("commit_id"), F.max("change_number").alias("change_number"), F.count("*").alias("txn_count"))
    old = rows.select("device_id").distinct().select("device_id", F.lit(-1).cast("long").alias("segment_seq"), F.lit(0).cast("long").alias("commit_id"), F.lit(-1).cast("long").alias("change_number"), F.lit(7).cast("long").alias("txn_count"))
    return C.merge_checkpoints(old, applied)


@query(f"""with {BODY}, p as (select device_id, d, max(segment_seq) filter (where segment_seq % (d + 2) = 0 and (device_id <> 'dev2' or d < 2)) as s from body, (values (0), (1), (2)) as x(d) group by all)
select device_id, min(coalesce(s, -1)) - 1 as target from p group by device_id having min(coalesce(s, -1)) - 1 > 0""")
def min_watermark(spark, sf_dir):
    rows = bodies(spark, sf_dir)
    parts = []
    for d in range(3):
        mine = (F.col("segment_seq") % (d + 2) == 0) & ((F.col("device_id") != "dev2") | F.lit(d < 2))
        parts.append(rows.groupBy("device_id").agg(F.max(F.when(mine, F.col("segment_seq"))).alias("segment_seq")))
    return C.cleanup_target(A.fan_in(parts))


@query("""with s as (select 'dev' || (o_custkey % 4) as device_id, o_orderkey // 100 as segment_seq, count(*) filter (where o_orderpriority = '1-URGENT') > 0 as applied from orders group by all),
f as (select device_id, segment_seq, segment_seq - row_number() over (partition by device_id order by segment_seq) as g from s where applied) select device_id, max(segment_seq) as watermark from f where g = -1 group by device_id""")
def cleanup_frontier(spark, sf_dir):
    """A segment counts as applied if it has an urgent order; what has not been applied holds the frontier back."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("dev"), (F.col("o_custkey") % 4).cast("string")).alias("device_id"), F.floor(F.col("o_orderkey") / 100).alias("segment_seq"), "o_orderpriority")
    segments = o.groupBy("device_id", "segment_seq").agg((F.count_if(F.col("o_orderpriority") == "1-URGENT") > 0).alias("applied"))
    return C.cleaned_watermark(segments.where("applied").drop("applied"))


@query("""with s as (select 'dev' || (c_custkey % 4) as device_id, c_custkey // 4 as segment_seq, case when c_custkey > 300 and c_nationkey = 7 then 'NEW' else 'READY_TO_APPLY' end as status from customer),
b as (select device_id, min(segment_seq) as stop from s where status = 'NEW' group by all) select s.* from s left join b using (device_id) where stop is null or segment_seq < stop""")
def ship_frontier(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("dev"), (k % 4).cast("string")).alias("device_id"), F.floor(k / 4).alias("segment_seq"), F.when((k > 300) & (F.col("c_nationkey") == 7), "NEW").otherwise("READY_TO_APPLY").alias("status"))
    return C.shippable(rows)


@query("select p_partkey, least(100 * pow(2, p_size - 1), 30000)::bigint as wait_ms from part")
def backoff_schedule(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.backoff(F.col("p_size")).alias("wait_ms"))


@query(f"with {BODY} select device_id, max(segment_seq) + 1 as next_seq, max(commit_id) as last_commit from body group by all")
def resume_scan(spark, sf_dir):
    return C.resume_point(bodies(spark, sf_dir))


@query("""select 'd' || (c_custkey % 100) as device_id, c_name as name, case when c_custkey % 3 = 0 then 'new' else c_mktsegment end as value from customer where c_custkey % 100 <> 7""")
def metadata_properties(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") % 100).cast("string")).alias("device_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"), "c_custkey")
    new = c.where("c_custkey % 3 = 0").select("device_id", "name", F.lit("new").alias("value"))
    return C.forget_device(C.properties_upsert(c.drop("c_custkey"), new), ["d7"])


# --- statistics ----------------------------------------------------------------------------------


@query(f"""with {BODY} select device_id, 'accounts' as table_name, count(*) filter (where op = 'INSERT') as insert_rows, count(*) filter (where op = 'UPDATE') as update_rows, count(*) filter (where op = 'DELETE') as delete_rows,
 0::bigint as create_table, 0::bigint as drop_table, 0::bigint as add_column, 0::bigint as drop_column, 0::bigint as rename_column, 0::bigint as rename_table from body group by device_id""")
def table_statistics(spark, sf_dir):
    return G.table_statistics(marked(L.carry_forward(bodies(spark, sf_dir))), by=["device_id"])


@query(f"""with {BODY}, s as (select device_id, segment_seq, count(*) filter (where op <> 'DELETE') as operations, (sum(id) + 100)::bigint as bytes from body group by all)
select device_id, sum(operations)::bigint as operations, count(*) filter (where operations > 0) as transactions, sum(bytes)::bigint as bytes from s group by device_id""")
def device_statistics(spark, sf_dir):
    return G.device_statistics(_segments(spark, sf_dir))


def _segments(spark, sf_dir):
    return bodies(spark, sf_dir).groupBy("device_id", "segment_seq").agg(F.count_if(F.col("op") != "DELETE").alias("operations"), (F.sum("id") + 100).alias("bytes"))


@query(f"""with {BODY}, s as (select device_id, segment_seq, count(*) filter (where op <> 'DELETE') as operations, (sum(id) + 100)::bigint as bytes from body group by all)
select device_id, segment_seq, (sum(operations) over w)::bigint as total_operations, (sum(bytes) over w)::bigint as total_bytes, count(*) over w as total_segments from s window w as (partition by device_id order by segment_seq)""")
def dashboard_totals(spark, sf_dir):
    return G.dashboard(_segments(spark, sf_dir)).drop("operations", "bytes")


@query("with e as (select 'dev' || (user_id % 4) as device_id, max_by(event_type, ts) as status, max(ts) as ts from events group by all) select * from e")
def device_status(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("dev"), (F.col("user_id") % 4).cast("string")).alias("device_id"), F.col("event_type").alias("status"), "ts")
    return G.device_status(e)


@query(f"""with {BODY}, s as (select 'dev' || (user_id % 5) as device_id, max(event_id // 5) as source_commit from events group by all), u as (select device_id, max(segment_seq) * 3 // 4 as upto from good group by all), a as (select device_id, max(commit_id) as applied_commit from good join u using (device_id) where segment_seq <= upto group by all)
select device_id, source_commit, applied_commit, case when applied_commit is null then -1 else greatest(source_commit - applied_commit, 0) end as latency_ms from s left join a using (device_id)""")
def sync_latency(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    source = e.groupBy(F.concat(F.lit("dev"), (F.col("user_id") % 5).cast("string")).alias("device_id")).agg(F.max(F.floor(F.col("event_id") / 5)).alias("source_commit"))
    # each device's checkpoint: three quarters of its log
    good = L.committed(logged(spark, sf_dir)).where("op is not null").select("device_id", "segment_seq", "commit_id")
    upto = good.groupBy("device_id").agg(F.floor(F.max("segment_seq") * 3 / 4).alias("upto"))
    done = good.join(F.broadcast(upto), "device_id").where("segment_seq <= upto").groupBy("device_id").agg(F.max("commit_id").alias("applied_commit"))
    return G.sync_latency(source, done)


# --- schema --------------------------------------------------------------------------------------


@query("select s_suppkey as id, s_name as name, null as phone from supplier where s_suppkey % 2 = 0 union all select s_suppkey, s_name, 'p' || s_nationkey from supplier where s_suppkey % 2 = 1")
def schema_evolution_union(spark, sf_dir):
    reg = D.Registry(consolidated=True)
    for sql in ("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT)", "ALTER TABLE t ADD COLUMN phone TEXT", "ALTER TABLE t DROP COLUMN name"):
        reg.apply(sql)
    s = read(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = s.where("s_suppkey % 2 = 1").select(F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("phone"), F.col("s_suppkey").alias("ID"), F.col("s_name").alias("name"))
    return A.fan_in([reg.conform(d, "t") for d in (old, new)])


@query(f"with {BODY} select device_id, segment_seq, change_number, case when (segment_seq, change_number) < (3, 1000) then 3 when (segment_seq, change_number) < (8, 0) then 4 else 3 end as width from body")
def schema_versions(spark, sf_dir):
    ddl = [(d, 0, -1, "CREATE TABLE accounts(id INTEGER PRIMARY KEY, kind TEXT, amount REAL)") for d in ("dev0", "dev1", "dev2", "dev3")]
    ddl += [(d, 3, 1000, "ALTER TABLE accounts ADD COLUMN note TEXT") for d in ("dev0", "dev1", "dev2", "dev3")]
    ddl += [(d, 8, 0, "ALTER TABLE accounts DROP COLUMN note") for d in ("dev0", "dev1", "dev2", "dev3")]
    known = D.versions(spark, D.fold(spark.createDataFrame(ddl, "device_id string, segment_seq long, change_number long, sql string")))
    rows = bodies(spark, sf_dir).select("device_id", "segment_seq", "change_number", F.lit("ACCOUNTS").alias("table_name"))
    return D.attach_versions(rows, known).select("device_id", "segment_seq", "change_number", "width")


# --- plain relational SQL over the tables, as consolidated tables are queried --------------------


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_price, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_price"), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("""select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where r_name = 'ASIA' group by n_name""")
def orders_by_nation(spark, sf_dir):
    small = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey"))
    return read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type, n, rank from (select *, row_number() over (partition by event_type order by n desc, user_id) as rank from c) where rank <= 3""")
def top_users(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")).cast("long")).where("rank <= 3").select("user_id", "event_type", "n", "rank")


@query("""with l as (select event_id, user_id, epoch_us(ts) as at from events where event_type = 'purchase'), r as (select user_id, epoch_us(ts) as at, max(value) as viewed from events where event_type = 'view' group by all)
select l.event_id, l.user_id, r.viewed from l asof left join r on l.user_id = r.user_id and l.at >= r.at""")
def last_view_before_purchase(spark, sf_dir):
    """An as-of join: each purchase with the latest view of its user."""
    e = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'view'").select("user_id", "at", F.col("value").alias("viewed"))
    return J.as_of_join(left, right, ["user_id"], "at", ["viewed"]).drop("at")


@query("""with r as (select n_nationkey, n_nationkey * 400.0::double - 1000 as low, n_nationkey * 400.0::double - 100 as high from nation)
select n_nationkey, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join r on c_acctbal >= low and c_acctbal < high group by all""")
def customers_by_balance_range(spark, sf_dir):
    """A range join: customers in each of overlapping bands of balance."""
    n = F.col("n_nationkey") * 400.0
    bands = read(spark, sf_dir, "nation").select("n_nationkey", (n - 1000).alias("low"), (n - 100).alias("high"))
    met = J.range_join(read(spark, sf_dir, "customer").select("c_acctbal"), bands, "c_acctbal", "low", "high", 900.0)
    return met.groupBy("n_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag) as no_flag, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup(l_returnflag, l_linestatus)""")
def quantity_rollup(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping("l_returnflag").cast("long").alias("no_flag"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""select c_mktsegment, c_nationkey, count(*) as n, round(avg(c_acctbal), 4) as average from customer group by cube(c_mktsegment, c_nationkey)""")
def customer_cube(spark, sf_dir):
    return read(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("average"))


@query("""select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())""")
def order_grouping_sets(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return rows.groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@query("""select 'both' as part, c_nationkey as nation from (select c_nationkey from customer where c_acctbal > 9000 intersect select s_nationkey from supplier where s_acctbal > 5000)
union all select 'customers only', c_nationkey from (select c_nationkey from customer where c_acctbal > 9000 except select s_nationkey from supplier where s_acctbal > 5000)
union all select 'all', c_nationkey from (select c_nationkey from customer where c_acctbal > 9000 except all select s_nationkey from supplier)""")
def nation_sets(spark, sf_dir):
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_acctbal")
    rich = s.where("s_acctbal > 5000").select("nation")
    parts = {"both": c.intersect(rich), "customers only": c.subtract(rich), "all": c.exceptAll(s.select("nation"))}
    return A.fan_in([p.select(F.lit(n).alias("part"), "nation") for n, p in parts.items()])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
