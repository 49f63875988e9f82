import pytest

from tidelog.plans import destinations as D
from tidelog.plans.registry import Registry


def test_prepare(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "src_device_id string, v int")
    assert D.prepare(spark, None, "v int").columns == ["v"]
    with pytest.raises(ValueError):
        D.prepare(spark, None, "v int", "APPEND_DATA")
    assert D.prepare(spark, state, "", "APPEND_DATA").count() == 3 and D.prepare(spark, state, "", "OVERWRITE_OBJECT").count() == 0
    assert D.prepare(spark, state, "", "DELETE_DATA", "a").count() == 2


def test_triggers(spark):
    t = D.Triggers.parse('{"acc": ["SELECT count(*) AS n FROM acc"], "none": "SELECT 1"}')
    out = t.run({"ACC": spark.range(4).toDF("id"), "other": spark.range(1).toDF("id")})
    assert list(out) == ["ACC"] and out["ACC"][0].first().n == 4


@pytest.mark.parametrize("text,kind,want", [
    ("jdbc:sqlite:/a/b.db?x=1", "sqlite", {"path": "/a/b.db"}), ("/c.db", "duckdb", {"path": "/c.db"}),
    ("jdbc:postgresql://h:5432/d?user=u&password=p&ssl=true", "postgres", {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": "p", "ssl": "true"}),
    ("postgres://u:p@h/d", "postgres", {"url": "jdbc:postgresql://h/d", "user": "u", "password": "p"})])
def test_connection(text, kind, want):
    assert D.connection(text, kind) == want


def test_bad_connection():
    for text, kind in (("", "sqlite"), ("mysql://x", "postgres")):
        with pytest.raises(ValueError):
            D.connection(text, kind)


def test_retry():
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("database is locked")
        return "done"

    assert D.retry(work, 3, 1) == "done"
    with pytest.raises(OSError):
        D.retry(lambda: (_ for _ in ()).throw(OSError("syntax")), 3, 1, lambda m: "locked" in m)


def test_analysis_and_snapshot(spark):
    reg = Registry()
    reg.apply("CREATE TABLE t(id INTEGER PRIMARY KEY, v VARCHAR(9))")
    assert D.analyses(spark, "SELECT id FROM t WHERE v = 'x'", reg) is None and "nope" in D.analyses(spark, "SELECT nope FROM t", reg)
    assert D.rebuild(D.catalog_snapshot(spark, "d", reg))["d"].tables == reg.tables
    assert [tuple(r) for r in D.initial_statistics({"t": spark.range(3), "u": spark.range(0)}, "d").collect()] == [("d", "t", 3), ("d", "u", 0)]


def test_control_files_and_settings(tmp_path):
    for a in D.CONTROL_FILES:
        (tmp_path / f"{a}.dev").write_text("")
    assert D.take_control_files(str(tmp_path), "dev") == ["reinitialize", "resume_sync"] and D.take_control_files(str(tmp_path), "dev") == []
    assert D.indexed_settings("a = 1\na-2 = 2\nb-1 = 3\n") == {1: {"a": "1", "b": "3"}, 2: {"a": "2"}}
