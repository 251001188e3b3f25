"""Decisions of one time: the first row counts, however the rows are dealt; odd quantities are as in the SQL."""

import datetime as dt

import duckdb
import pytest

from orrery import catalog
from orrery.operators import review as V


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Every order has two lines of the highest price, far from each other, and the quantities 1.5, 2.5, -1 and null occur."""
    at = str(tmp_path_factory.mktemp("ties"))
    quantity = [2.0, 3.0, 1.5, 2.5, -1.0, None, 4.0]
    lines = [(o, quantity[(o + turn) % 7], [9.0, 9.0, 5.0, None][turn]) for turn in range(4) for o in range(300)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(o, o * 3, "O", 1.0, dt.datetime(2020, 1, 1)) for o in range(303)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{at}/orders.parquet")
    return at


def in_order(at, name):
    """The SQL with one thread, which takes rows as they come."""
    con = duckdb.connect()
    con.sql("set threads = 1")
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    q = con.sql(catalog.oracle_sql()[name])
    return q.columns, sorted(map(str, q.fetchall()))


def as_spark(spark, at, name):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        columns, want = in_order(at, name)
        return sorted(map(str, (tuple(r) for r in catalog.queries()[name](spark, at).select(columns).collect()))), want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_decisions_of_one_time(spark, tables):
    got, want = as_spark(spark, tables, "review_decisions")
    assert got == want and len(got) > 4


def test_no_order_of_rows_matters(spark):
    tasks = spark.createDataFrame([(1, "pending")], "id long, status string")
    rows = [(1, "skip", "a", 5), (1, "merge_left", "b", 5), (1, "different", "c", 4), (1, "same_entity", "d", None)]
    make = lambda r: spark.createDataFrame(r, "task_id long, resolution string, reviewer string, decided_at long").coalesce(1)
    assert V.reviewed(tasks, make(rows)).collect() == V.reviewed(tasks, make(rows[::-1])).collect()


def test_merges_of_one_time(spark, tables):
    got, want = as_spark(spark, tables, "review_merges")
    assert got == want and len(got) > 50


@pytest.mark.parametrize("query", ["review_decisions", "review_merges"])
def test_first_of_several_files(spark, tables, tmp_path, query):
    """The first of equal times stands late in the first file, the other early in a later one."""
    lines = [[(o, float(o % 5), 9.0) for o in range(300)], [(o, float((o + 2) % 5), 9.0) for o in reversed(range(300))], [(o, 4.0, 9.0) for o in range(300)]]
    con = duckdb.connect()
    (tmp_path / "lineitem.parquet").mkdir()
    for name, part in zip(("a", "a-b", "b"), lines, strict=True):
        con.sql("create or replace table l (l_orderkey bigint, l_quantity double, l_extendedprice double)")
        con.executemany("insert into l values (?, ?, ?)", part)
        con.sql(f"copy l to '{tmp_path}/lineitem.parquet/{name}.parquet' (format parquet)")
    spark.read.parquet(f"{tables}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got, want = as_spark(spark, str(tmp_path), query)
    assert got == want and len(got) > 3
