import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.rules import FilterRules, ValueMap
from tidelog.operators import apply as A
from tidelog.operators import control as C
from tidelog.operators import joins as J
from tidelog.operators import log as L
from tidelog.operators import stats as G
from tidelog.plans import engine
from tidelog.plans.registry import Registry
from tidelog.plans.replay import Mapping, Replica
from tidelog.sources import segments as seg
from tidelog.sources.state import VersionedTable
from tidelog.streaming.consolidate import Consolidation, append_only

LOG = "device_id string, segment_seq long, change_number long, commit_id long, sql string"


def log(spark, rows):
    return spark.createDataFrame([("d", 0, n, c, s) for n, c, s in rows], LOG)


def test_carry_forward(spark):
    rows = [(0, 1, None), (1, 1, "a"), (2, 1, None), (3, 2, " "), (4, 2, None)]
    assert [(r.change_number, r.sql) for r in L.carry_forward(log(spark, rows)).orderBy("change_number").collect()] == [(1, "a"), (2, "a"), (3, " "), (4, " ")]
    assert [r.sql for r in L.carry_forward(log(spark, rows), changes=True).orderBy("change_number").collect()] == ["", "a", "a", "a", "a"]


def test_fates_and_committed(spark):
    rows = [(0, 10, "BEGIN"), (1, 10, "x"), (2, 10, "COMMIT"), (3, 11, "x"), (4, 11, "rollback to s"), (5, 12, "x"), (6, 13, "ROLLBACK"), (7, 13, " commit")]
    assert {r.commit_id: r.fate for r in L.fates(log(spark, rows)).collect()} == {10: "Commit", 11: "Rollback", 12: "Unknown", 13: "Commit"}
    assert sorted(r.commit_id for r in L.committed(log(spark, rows)).collect()) == [10, 10, 10, 13, 13]
    assert L.committed(log(spark, rows), parity=True).count() == 8
    assert L.max_committed(log(spark, rows)).first().max_commit_id == 13


def test_sidecars(spark):
    outer = log(spark, [(0, 1, "BEGIN"), (1, 1, "REPLAY_TXN"), (2, 1, "COMMIT")])
    inner = log(spark, [(0, 1, "BEGIN"), (1, 1, "x"), (2, 1, "y"), (3, 1, "COMMIT")])
    got = L.expand_sidecars(outer, inner).orderBy("change_number", "ordinal").collect()
    assert [(r.change_number, r.sql) for r in got] == [(0, "BEGIN"), (1, "x"), (1, "y"), (2, "COMMIT")]
    with pytest.raises(Exception, match="no sidecar"):
        L.expand_sidecars(outer, inner.where("commit_id = 9")).collect()
    assert L.decided_segments(outer.where("change_number < 2"), inner).count() == 1
    assert L.decided_segments(outer.where("change_number < 2")).count() == 0


def test_repair(spark):
    rows = spark.createDataFrame([("a", 0, 0, 5, "x"), ("b", 0, 0, 5, "x"), ("b", 0, 1, 6, "y"), ("c", 0, 0, 6, "z")], LOG)
    sources = spark.createDataFrame([("a", 5, "SQLITE"), ("b", 5, "DUCKDB"), ("c", 5, "SQLITE")], "device_id string, source_commit long, device_type string")
    logs = spark.createDataFrame([("a", 5, "Unknown"), ("b", 6, "Unknown"), ("c", 6, "Unknown")], "device_id string, log_commit long, fate string")
    out = L.repair(rows, L.resolve_in_doubt(sources, logs)).orderBy("device_id", "change_number").collect()
    assert [(r.device_id, r.change_number, r.sql) for r in out] == [("a", 0, "x"), ("a", 1, "COMMIT"), ("b", 0, "x"), ("c", 0, "z"), ("c", 1, "ROLLBACK")]


def random_changes(seed, n=120):
    r = random.Random(seed)
    out = []
    for k in range(n):
        op = r.choice(["INSERT", "INSERT", "UPDATE", "DELETE"])
        image = lambda: [str(r.randint(0, 3)), r.choice(["x", "y", None])]
        out.append(("d", k // 50, k % 50, op, None if op == "INSERT" else image(), None if op == "DELETE" else image()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bag_fold_equals_plain_one(spark, seed):
    rows = random_changes(seed)
    table = []
    for _, _, _, op, before, after in rows:
        if op == "INSERT":
            table.append(after)
        elif None not in before:
            hit = [x for x in table if x == before]
            table = [x for x in table if x != before] + ([after] * len(hit) if op == "UPDATE" else [])
    df = spark.createDataFrame(rows, "device_id string, segment_seq long, change_number long, op string, before array<string>, after array<string>").repartition(3)
    got = [(tuple(r.image), r.copies) for r in A.bag_apply(df, ["device_id"]).collect()]
    assert dict(got) == {k: [tuple(x) for x in table].count(k) for k in {tuple(x) for x in table}}


@pytest.mark.parametrize("seed", [4, 5])
def test_keyed_fold_equals_plain_one(spark, seed):
    r = random.Random(seed)
    rows, table = [], {}
    for k in range(200):
        old, new = r.randint(0, 9), r.randint(0, 9)
        op = r.choice(["INSERT", "UPDATE", "DELETE"])
        before, after = (None if op == "INSERT" else (old, "o")), (None if op == "DELETE" else (new, f"v{k}"))
        if before:
            table.pop(old, None)
        if after:
            table[new] = f"v{k}"
        rows.append(("d", k // 70, k % 70, before, after))
    df = spark.createDataFrame(rows, "device_id string, segment_seq long, change_number long, before struct<id:int,v:string>, after struct<id:int,v:string>")
    signed = A.signed(df, ["id"], ["v"])
    order = ["segment_seq", "change_number", "ordinal"]
    assert {x.id: x.v for x in A.keyed_apply(signed, ["device_id", "id"], order).collect()} == table
    first = A.keyed_apply(signed.where("segment_seq = 0"), ["device_id", "id"], order)
    assert {x.id: x.v for x in A.keyed_apply(signed.where("segment_seq > 0"), ["device_id", "id"], order, state=first).collect()} == table


def test_golden_row_images(spark):
    """The statement sequence whose exact images are known: two inserts, a self-insert, a shift of ids, a delete of all."""
    replica = Replica(spark)
    replica.run("CREATE TABLE t(id INTEGER, v TEXT)")
    images = []
    for sql, args in (("INSERT INTO t VALUES(?, ?)", [1, "a"]), ("INSERT INTO t VALUES(2, 'b')", []), ("INSERT INTO t SELECT * FROM t", []), ("UPDATE t SET id = id + 10", []), ("DELETE FROM t WHERE id > 0", [])):
        images.append(sorted((r.op, r.before and tuple(r.before), r.after and tuple(r.after)) for r in replica.run(sql, args).collect()))
    a, b, a2, b2 = (1, "a"), (2, "b"), (11, "a"), (12, "b")
    assert images[0] == [("INSERT", None, a)] and images[1] == [("INSERT", None, b)] and images[2] == [("INSERT", None, a), ("INSERT", None, b)]
    assert images[3] == [("UPDATE", a, a2)] * 2 + [("UPDATE", b, b2)] * 2
    assert images[4] == [("DELETE", a2, None)] * 2 + [("DELETE", b2, None)] * 2
    assert replica.tables["T"].count() == 0
    # what reads other tables, has another result each time, or names what isn't there is put aside
    for k, bad in enumerate(("UPDATE t SET v = (SELECT v FROM u)", "UPDATE t SET id = random()", "UPDATE t SET nope = 5", "INSERT INTO t(id, v) VALUES(3)", "INSERT INTO t(id, w) VALUES(3, 4)", "DELETE FROM t WHERE nope = 1"), 1):
        assert replica.run(bad) is None and len(replica.quarantine) == k, bad


def test_statements_beyond_comparisons(spark):
    replica = Replica(spark)
    replica.run("CREATE TABLE t(id INTEGER, v TEXT, b BLOB, n REAL)")
    replica.run("INSERT INTO main.t VALUES (1, 'a, b', x'DEAD', 1.5), (2, 'it''s WHERE', NULL, ?), (3, 'C:\\x', ?, -2)", [2.5, b"\xbe\xef"])
    replica.run('UPDATE "t" SET v = lower(v) || \', x\', n = n * 2 WHERE id IN (1, ?) OR v LIKE \'c:%\'', [9])
    replica.run("INSERT INTO t(v, id) SELECT v, id + 10 FROM t WHERE b IS NOT NULL")
    replica.run("DELETE FROM t WHERE n BETWEEN 2.4 AND 2.6 AND NOT (v IS NULL)")
    got = sorted((r.id, r.v, r.b and bytes(r.b), r.n) for r in replica.tables["T"].collect())
    assert got == [(1, "a, b, x", b"\xde\xad", 3.0), (3, "c:\\x, x", b"\xbe\xef", -4.0), (11, "a, b, x", None, None), (13, "c:\\x, x", None, None)]
    assert not replica.quarantine


def test_registry():
    ddl = ("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)", "ALTER TABLE t ADD COLUMN n REAL DEFAULT 1", "ALTER TABLE t ADD COLUMN n REAL", "ALTER TABLE t RENAME COLUMN v TO w", "ALTER TABLE t DROP COLUMN n", "ALTER TABLE t RENAME TO u", "DROP TABLE x")
    mirror, merged = Registry(), Registry(consolidated=True)
    for sql in ddl:
        mirror.apply(sql)
        merged.apply(sql)
    assert [c.name for c in mirror.tables["U"]] == ["id", "w"] and "T" not in mirror.tables and mirror.keys("u") == ["id"]
    assert [c.name for c in merged.tables["T"]] == ["id", "v", "n", "w"] == [c.name for c in merged.tables["U"]]
    assert merged.schema("t").startswith("src_device_id string, src_device_name string, src_update_ts string, `id` bigint")


def test_control(spark):
    seg_rows = spark.createDataFrame([("d", 0, "READY_TO_APPLY"), ("d", 2, "READY_TO_APPLY"), ("d", 3, "NEW"), ("d", 4, "READY_TO_APPLY"), ("e", 1, "READY_TO_APPLY")], "device_id string, segment_seq long, status string")
    assert sorted((r.device_id, r.segment_seq) for r in C.shippable(seg_rows).collect()) == [("d", 0), ("d", 2), ("e", 1)]
    done = spark.createDataFrame([("d", 0), ("d", 1), ("d", 3), ("e", 1)], "device_id string, segment_seq long")
    assert [tuple(r) for r in C.cleaned_watermark(done).collect()] == [("d", 1)]
    assert C.unapplied(seg_rows, done).count() == 2
    progress = spark.createDataFrame([("d", 2), ("d", 5), ("e", None), ("e", 9)], "device_id string, segment_seq long")
    assert [tuple(r) for r in C.cleanup_target(progress).collect()] == [("d", 1)]
    assert [r.w for r in spark.range(1, 12).select(C.backoff(F.col("id")).alias("w")).collect()] == [100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 30000, 30000]
    state = spark.createDataFrame([("d", 5, 7, 1, 3)], "device_id string, commit_id long, change_number long, segment_seq long, txn_count long")
    new = spark.createDataFrame([("d", 9, -1, 2, 4), ("e", 1, 0, 0, 1)], state.schema)
    assert sorted(tuple(r) for r in C.merge_checkpoints(state, new).select(*state.columns).collect()) == [("d", 9, 7, 2, 7), ("e", 1, 0, 0, 1)]
    assert C.seed_checkpoint(log(spark, [(0, 4, "x")])).first().change_number == -1
    assert G.exposition(dict.fromkeys(G.GAUGES, 2)).startswith("# TYPE tidelog_devices gauge\ntidelog_devices 2\n")


def test_statistics_modes(spark):
    rows = log(spark, [(0, 1, "INSERT INTO t VALUES(1)"), (1, 1, "DROP TABLE t"), (2, 1, "ALTER TABLE t RENAME TO u"), (3, 1, "ALTER TABLE t RENAME COLUMN a TO b"), (4, 1, "COMMIT")])
    got = {r.table_name: r for r in G.table_statistics(rows).collect()}
    assert (got["t"].insert_rows, got["t"].drop_table, got["t"].add_column, got["u"].create_table) == (1, 0, 1, 1)
    plain = {r.table_name: r for r in G.table_statistics(rows, consolidation=False).collect()}
    assert (plain["t"].drop_table, plain["t"].rename_column, plain["t"].rename_table) == (1, 1, 1) and "u" not in plain


def test_segment_files(spark, tmp_path):
    top = str(tmp_path)
    for device, seq in (("a", 2), ("a", 10), ("b", 0)):
        w = seg.SegmentWriter(os.path.join(top, device), seq)
        w.append(1, "INSERT INTO t VALUES(?)", list(range(20)))
        w.append(1, None, [None, b"\x01", 1.5])
        w.append(1, "COMMIT")
        w.finish()
        with pytest.raises(ValueError):
            w.append(2, "x")
    open_ = seg.SegmentWriter(os.path.join(top, "b"), 1)
    open_.append(2, "x")
    open_.flush()
    (tmp_path / "b" / "0.sqllog.1.txn").write_text("no segment")
    assert [(d, s) for d, _, s, _ in seg.discover(top)] == [("a", 2), ("a", 10), ("b", 0), ("b", 1)]
    rows = seg.read_segments(spark, top).orderBy("device_id", "segment_seq", "change_number").collect()
    assert len(rows) == 9 and rows[0].args[19] == "19" and rows[1].args == [None, "01", "1.5"] and rows[1].sql is None
    assert seg.read_segments(spark, top, after={"a": 3, "b": 1}).count() == 3
    assert seg.read_segments(spark, top, ready=False).where("device_id = 'b'").count() == 4
    assert one_seq(spark) == [10, None]
    shipped = seg.ship(os.path.join(top, "a", "2.sqllog"), os.path.join(top, "archive"))
    seg.mark_applied(shipped)
    assert seg.status(seg.ship(os.path.join(top, "a", "2.sqllog"), os.path.join(top, "archive"))) == "APPLIED"


def one_seq(spark):
    return [r.x for r in spark.createDataFrame([("x/10.cdclog",), ("x/10.sqllog.1.txn",)], "p string").select(seg.segment_seq(F.col("p")).alias("x")).collect()]


def test_versioned_state(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    assert t.write(spark.range(3).toDF("id"), 0) and t.write(spark.range(5).toDF("id"), 1) and not t.write(spark.range(9).toDF("id"), 1)
    assert t.read().count() == 5 and t.version() == 1
    t.write(spark.range(1).toDF("id"), 5)
    t.prune(1)
    assert sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("v=")) == ["v=5"]


def test_stream_equals_batch(spark, tmp_path):
    from tidelog import queries as q

    source, schema = str(tmp_path / "log"), None
    all_ = q.logged(spark, "/root/testdata/sf0.001").select("device_id", "segment_seq", "change_number", "commit_id", "sql", "op", "id", "kind", "amount", (F.col("op") == "DELETE").alias("deleted"))
    schema = all_.schema.simpleString()[7:-1].replace(":", " ")
    job = Consolidation(spark, source, schema, ["id"], str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    for part in ("segment_seq < 1", "segment_seq >= 1"):
        all_.where(part).coalesce(1).write.mode("append").parquet(source)
        out = job.drain()
    assert job.drain().count() == out.count()  # nothing new
    want = q.cdc_apply_latest(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.device_id, r.id, r.kind, r.amount) for r in out.collect()) == sorted((r.device_id, r.id, r.kind, r.amount) for r in want)
    inserts = append_only(spark, source, schema).writeStream.format("memory").queryName("tidelog_inserts").trigger(availableNow=True).start()
    inserts.awaitTermination()
    assert spark.table("tidelog_inserts").count() == all_.where("op = 'INSERT'").count()


def test_late_segments_and_fresh_checkpoint(spark, tmp_path):
    """A segment that comes after later ones overwrites nothing; a stream that begins anew loses nothing."""
    source, schema = str(tmp_path / "log"), "device_id string, segment_seq long, change_number long, commit_id long, sql string, op string, id long, v string, deleted boolean"

    def segment(seq, rows):
        marks = [("d", seq, len(rows), seq, "COMMIT", None, None, None, None)]
        spark.createDataFrame([("d", seq, k, seq, "x", "UPDATE", *r) for k, r in enumerate(rows)] + marks, schema).coalesce(1).write.mode("append").parquet(source)

    def job(checkpoint):
        return Consolidation(spark, source, schema, ["id"], str(tmp_path / "table"), str(tmp_path / checkpoint))

    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    first = job("one")
    segment(5, [(1, "new", False), (2, "x", False), (3, None, True)])
    assert rows(first.drain()) == [(1, "new"), (2, "x")]
    segment(3, [(1, "old", False), (3, "old", False), (4, "y", False)])
    assert rows(first.drain()) == [(1, "new"), (2, "x"), (4, "y")]
    segment(9, [(2, None, True), (5, "z", False)])
    assert rows(job("two").drain()) == [(1, "new"), (4, "y"), (5, "z")] == rows(job("one").drain())


def test_state_rewrites_touched_buckets_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), buckets=8)
    rows = lambda ids, seq: spark.createDataFrame([(i, seq, 0, f"{i}.{seq}", False) for i in ids], "id long, segment_seq long, change_number long, v string, deleted boolean")
    fold = lambda changes, state: A.keyed_merge(changes, ["id"], state)
    assert t.update(rows(range(100), 0), ["id"], fold, 0) and not t.update(rows([1], 9), ["id"], fold, 0)
    assert t.update(rows([7], 1), ["id"], fold, 1) and t.update(rows([7], 2), ["id"], fold, 0, "other run")
    assert {r.id: r.v for r in A.live(t.read()).collect()} == {**{i: f"{i}.0" for i in range(100)}, 7: "7.2"}
    assert len([p for p in os.listdir(tmp_path / "t" / "v=1") if "=" in p]) == 1
    t.prune(1)
    assert A.live(t.read()).count() == 100 and not os.path.isdir(tmp_path / "t" / "v=1")


def test_segments_keep_storage_classes(spark, tmp_path):
    w = seg.SegmentWriter(str(tmp_path / "a"), 0)
    w.append(1, "INSERT INTO t VALUES(?, ?, ?, ?, ?)", [b"\xde\xad", "DEAD", 7, 1.5, None])
    w.finish()
    row = seg.read_segments(spark, str(tmp_path)).first()
    assert seg.arguments(row) == [b"\xde\xad", "DEAD", 7, 1.5, None]


@pytest.mark.parametrize("kind", ["SQLITE", "DUCKDB"])
def test_close_drops_what_was_not_committed(spark, tmp_path, kind):
    a = engine.Device(kind, "alpha", str(tmp_path))
    a.execute("CREATE TABLE t(id INTEGER, v TEXT)")
    a.execute("INSERT INTO t VALUES(1, 'x')")
    a.execute("begin")
    a.execute("INSERT INTO t VALUES(2, 'y')")
    with pytest.raises(RuntimeError, match="open elsewhere"):
        engine.Device(kind, "alpha", str(tmp_path))
    a.close()
    b = engine.Device(kind, "alpha", str(tmp_path))
    assert b.query("SELECT id FROM t") == [(1,)]
    b.close()
    log = seg.read_segments(spark, str(tmp_path / "stage"))
    assert {r.fate for r in L.fates(log).collect()} == {"Commit", "Rollback"}
    dst = engine.Destination(spark, str(tmp_path / "stage"))
    dst.sync()
    assert [r.id for r in dst.table("t").collect()] == [1]


@pytest.mark.parametrize("kind,database,mark", [("SQLITE", True, "COMMIT"), ("SQLITE", False, "ROLLBACK"), ("DUCKDB", False, None)])
def test_crash_between_log_and_database(tmp_path, kind, database, mark):
    """The log has a commit without its fate; whether the database has it decides on opening."""
    a = engine.Device(kind, "alpha", str(tmp_path))
    a.execute("CREATE TABLE t(id INTEGER)")
    a.database.begin()
    a.database.execute("INSERT INTO t VALUES(1)")
    commit = a._next_commit()
    a.writer.append(commit, "BEGIN")
    a.writer.append(commit, "INSERT INTO t VALUES(1)")
    a.writer.flush()
    a.database.end("COMMIT" if database else "ROLLBACK", commit)
    path = a.writer.path
    for x in (a.writer.connection, a.database, a.lock):  # gone without close()
        x.close()
    b = engine.Device(kind, "alpha", str(tmp_path))
    assert b.query("SELECT count(*) FROM t") == [(int(database),)] and seg.status(path) == "READY_TO_APPLY"
    last = [r[3:5] + r[7:8] for r in seg.read_segment("alpha", path)][-1]
    assert last[2] == (mark or "COMMIT") and (last[1] == commit) == bool(mark)
    b.execute("INSERT INTO t VALUES(2)")
    assert b.committed_id > commit
    b.close()


def test_undecided_segments_wait(spark, tmp_path):
    def write(seq, *marks):
        w = seg.SegmentWriter(str(tmp_path / "d"), seq)
        for k, m in enumerate(marks):
            for sql in (["CREATE TABLE t(id INTEGER)"] if seq == k == 0 else []) + [f"INSERT INTO t VALUES({seq})", *([m] if m else [])]:
                w.append(10 * seq + k + 1, sql)
        w.finish()

    write(0, "COMMIT")
    write(1, "COMMIT", None)
    write(2, "COMMIT")
    dst = engine.Destination(spark, str(tmp_path))
    dst.sync()
    assert [r.id for r in dst.table("t").collect()] == [0]
    os.remove(tmp_path / "d" / "1.sqllog")
    write(1, "COMMIT", "ROLLBACK")
    dst.sync()
    assert sorted(r.id for r in dst.table("t").collect()) == [0, 1, 2]


def test_joins_by_order(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 3, 4), ("a", 5, 5), ("c", 2, 6)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 10, "w"), (None, 3, "n"), ("c", 1, None)], "k string, t long, v string")
    got = {r.id: r.v for r in J.as_of_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {1: "z", 2: None, 3: None, 4: "n", 5: "z", 6: None}
    points = spark.createDataFrame([(-7.5,), (0.0,), (3.0,), (None,)], "x double")
    ranges = spark.createDataFrame([(1, -8.0, 3.0), (2, 3.0, 3.0), (3, 0.0, 100.0), (4, None, 1.0)], "r int, a double, b double")
    assert sorted((r.x, r.r) for r in J.range_join(points, ranges, "x", "a", "b", 4.0).collect()) == [(-7.5, 1), (0.0, 1), (0.0, 3), (3.0, 3)]


def test_log_is_on_disk_before_rotation(tmp_path):
    import sqlite3

    a = engine.Device("SQLITE", "alpha", str(tmp_path))
    a.execute("CREATE TABLE t(id INTEGER)")
    other = sqlite3.connect(a.writer.path)
    assert other.execute("select count(*) from commandlog").fetchone()[0] == 3
    other.close()
    a.close()


def test_devices_and_destination(spark, tmp_path):
    a, dst = engine.initialize(spark, "SQLITE", "alpha", str(tmp_path), filters="t = true\nt.secret = false", values='{"t.v": {"x": "EX"}}')
    b = engine.Device("SQLITE_STORE", "beta", str(tmp_path))
    stream = engine.Device("STREAMING", "gamma", str(tmp_path))
    assert dst.status(a) == "NotInitialized" and dst.latency(a) == -1
    a.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT, secret TEXT); INSERT INTO t VALUES(1, 'x', 's'); INSERT INTO t VALUES(2, 'y;z', 's')")
    a.execute("begin")
    a.execute("DELETE FROM t WHERE id = 1")
    a.execute("rollback")
    b.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, v TEXT)")
    assert b.execute_batch("INSERT INTO t VALUES(?, ?)", [[5, "x"], [6, "q"]]) == 2
    b.execute("UPDATE t SET v = ? WHERE id >= ?", ["w", 6])
    stream.execute("CREATE TABLE s(id INTEGER)")
    stream.execute("INSERT INTO s VALUES(1)")
    for bad in ("UPDATE s SET id = 1", "DELETE FROM s"):
        with pytest.raises(ValueError):
            stream.execute(bad)
    with pytest.raises(ValueError):
        b.execute("UPDATE t SET v = lower(v)")
    assert stream.query("SELECT count(*) FROM s") == [(0,)] and a.query("SELECT count(*) FROM t") == [(2,)]
    dst.pause()
    assert dst.sync() == 0 and dst.status(a) == "Paused"
    dst.resume()
    assert dst.await_sync(a) and dst.await_sync(b) and dst.await_sync(stream) and dst.status(a) == "Running"
    rows = dst.table("t").orderBy("src_device_id", "id").collect()
    assert [(r.src_device_id, r.id, r.v) for r in rows] == [("alpha", 1, "EX"), ("alpha", 2, "y;z"), ("beta", 5, "EX"), ("beta", 6, "w")]
    assert "secret" not in dst.table("t").columns and dst.sync() == 0
    dst.reinitialize("beta")
    assert dst.await_sync(b) and dst.table("t").count() == 4
    for d in (a, b, stream):
        d.close()


def test_options_and_mapping(spark):
    assert engine.Options.parse("rotate-rows = 5")["rotate_rows"] == 5 and engine.Options()["await_ms"] == 100
    for bad in ("", "a b", "x" * 65):
        with pytest.raises(ValueError):
            engine.device_name(bad)
    with pytest.raises(ValueError):
        engine.Options.parse("typo = 1")
    rows = spark.createDataFrame([("d", "n", "u", 1, "alice")], "device_id string, device_name string, update_ts string, id int, name string")
    out = Mapping(True, FilterRules.parse("t = true"), ValueMap.parse('{"t.name": {"alice": "AA"}}')).apply(rows, "t")
    assert out.columns == ["src_device_id", "src_device_name", "src_update_ts", "id", "name"] and out.first().name == "AA"
    assert Mapping(False).apply(rows, "t").columns == ["id", "name"] and Mapping(True, FilterRules()).apply(rows, "t") is None
