"""Every registered query against its SQL, or for a schema and rows where SQL cannot express it."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from fluxframe import queries

SF = "/root/testdata/sf0.001"
TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


def sorted_rows(columns, rows):
    order = sorted(columns)
    return order, sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in queries.ORACLE_SQL:
        assert got[1]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    assert got == sorted_rows([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["detrend_running_median", "pieces_running_median", "detrend_savgol", "pieces_savgol", "segment_stitch"])
def test_flux_of_zero_is_divided_by_as_in_sql(spark, tmp_path, name):
    """Curves whose first, last or only values are 0, so that trends and medians of segments are."""
    rows = [(user, i, float((i * 7 + user) % 5 + 1) if i not in (0, 20) and user < 3 else 0.0) for user, n in ((1, 21), (2, 45), (3, 12)) for i in range(n)]
    values = ", ".join(f"({100 * k + 1}, {user}, timestamp '2024-01-01' + interval {i} hours, {v}::double)" for k, (user, i, v) in enumerate(rows))
    con = duckdb.connect()
    con.execute(f"copy (select id::bigint as event_id, ts, u::bigint as user_id, 'x' as event_type, v as value, '' as props from (values {values}) t(id, u, ts, v)) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    found = con.execute(queries.ORACLE_SQL[name])
    want = sorted_rows([d[0] for d in found.description], found.fetchall())
    assert "nan" in str(want)
    assert str(sorted_rows(df.columns, [tuple(r) for r in df.collect()])) == str(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_one_exchange_serves_the_plan(spark):
    from fluxframe.operators.missing import fill_missing
    from fluxframe.operators.normalize import normalize
    from fluxframe.operators.outliers import remove_outliers

    lc = queries.curves(spark, SF)
    plan = normalize(remove_outliers(fill_missing(lc)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan
