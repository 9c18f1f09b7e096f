"""Every trace query against DuckDB SQL over the same tables."""

import decimal
import math
from datetime import date

import duckdb
import pytest

from iotrace.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["block_dashboard", "fs_dashboard", "nvme_dashboard"])
def test_dashboards_have_every_series(spark, sf_dir, name):
    found = {r[0] for r in QUERIES[name](spark, sf_dir).select("series").distinct().collect()}
    assert {"op_share", "iops", "cumulative_mb", "size_cdf", "latency_cdf_us", "gap_cdf"} <= found


def test_sums_of_times_pass_two_to_the_63rd(spark, tmp_path):
    """Totals are exact where a bigint would overflow, and bigint where it does not."""
    events = "select event_id, cast(ts as timestamp_ntz) ts, user_id, event_type, 1.0D value, 'k1' props from values {} t(event_id, ts, user_id, event_type)"
    orders = "select id o_orderkey, cast('{}' as timestamp_ntz) o_orderdate from range({n})"
    lines = "select id l_orderkey, cast('{}' as timestamp_ntz) l_shipdate from range({n})"
    for n, type_ in ((1, "bigint"), (40, "decimal(30,0)")):
        folder = f"{tmp_path}/{n}"
        rows = ", ".join(f"({2 * i}, '1970-01-01', {i}, 'view'), ({2 * i + 1}, '2200-01-01', {i}, 'purchase')" for i in range(n))
        spark.sql(events.format(rows)).write.parquet(f"{folder}/events.parquet")
        spark.sql(orders.format("0001-01-01", n=n)).write.parquet(f"{folder}/orders.parquet")
        spark.sql(lines.format("9999-01-01", n=n)).write.parquet(f"{folder}/lineitem.parquet")
        for name, each in (("nvme_latency", 7_258_118_400 * 10**9), ("order_lifecycle", (date(9999, 1, 1) - date(1, 1, 1)).days * 86_400 * 10**6)):
            df = QUERIES[name](spark, folder)
            assert dict(df.dtypes)["total_ns"] == type_
            assert [(r.paired, int(r.total_ns)) for r in df.collect()] == [(n, n * each)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
