import os

import duckdb
import pytest

from tidelog import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    got = [tuple(r) for r in df.select(columns).collect()]
    assert plain(got) == plain(want)


def test_flagship_is_the_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["device_id", "id", "kind", "amount"] and entry.entry(spark).count() > 0
    assert set(q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_latest_state_is_a_partial_aggregate(spark):
    plan = q.cdc_apply_latest(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan.split("partial_max_by")[0]


def test_scans_read_only_what_they_need(spark):
    plan = q.pricing_summary(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan and "l_partkey" not in plan
