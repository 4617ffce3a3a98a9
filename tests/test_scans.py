"""What reaches the scan: bounds on raw dates, lines of picked orders only, one pass for two tables."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators import filters
from tidemark.operators.filters import FilterParams
from tidemark.plans import QUERIES
from tidemark.session import pin
from tidemark.sources import bridge

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def scans(df, column: str) -> list[str]:
    """The file scans of the physical plan that read a column."""
    physical = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"FileScan parquet \[([^\]]*)\]", physical) if column in x]


LABELS = {
    "day": lambda d: d,
    "week": lambda d: d - dt.timedelta(d.weekday()),
    "closing week": lambda d: d + dt.timedelta(-d.weekday() % 7),
    "month": lambda d: d.replace(day=1),
}


@pytest.mark.parametrize("kind", LABELS)
def test_raw_days_are_the_days_of_the_labels(kind):
    days = [D(2023, 12, 20) + dt.timedelta(i) for i in range(120)]
    bounds = [None, *days[20:60:3]]
    for start in bounds:
        for end in bounds:
            first, after = dates.raw_days(kind, start, end)
            want = [d for d in days if (start is None or LABELS[kind](d) >= start) and (end is None or LABELS[kind](d) <= end)]
            assert [d for d in days if (first is None or d >= first) and (after is None or d < after)] == want, (kind, start, end)
    with pytest.raises(ValueError):
        dates.raw_days("year", D(2024, 1, 1))


@pytest.mark.parametrize("builder", [bridge.offline_sales, bridge.media_spend, bridge.line_cube, bridge.online_sales])
def test_bounds_are_pushed_to_the_files(spark, builder):
    found = builder(spark, SF, start="1996-01-01", end="1996-12-31")
    column = "o_orderdate" if builder is bridge.online_sales else "l_shipdate"
    pushed = " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", plan(found)))
    assert f"GreaterThanOrEqual({column},1996-01-01" in pushed and f"LessThan({column}," in pushed
    assert f"cast({column}" not in pushed


def test_the_filtered_trend_pushes_both_dates(spark):
    text = plan(QUERIES["kpi_trend_filtered"](spark, SF))
    pushed = " ".join(re.findall(r"PushedFilters: \[([^\]]*)\]", text))
    assert "GreaterThanOrEqual(l_shipdate,1997-03-10" in pushed and "GreaterThanOrEqual(o_orderdate,1997-03-05" in pushed


def test_dates_of_dates_are_compared_as_dates(spark):
    df = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 29),), (None,)], "d date")
    assert [r[0] for r in filters.period_filter(df, "d", "month", "2024-01-02").collect()] == [D(2024, 2, 29)]
    assert filters.period_filter(df, "d", "week").count() == 3


def test_only_lines_of_picked_orders_are_aggregated(spark):
    params = FilterParams(start_date="1997-01-01", industry="MACHINERY", lead_source="2-HIGH")
    orders = bridge.star(spark, SF, "orders")
    customer = bridge.star(spark, SF, "customer").filter("c_mktsegment = 'MACHINERY'")
    picked = pin(
        orders.filter("o_orderdate >= '1997-01-01' and o_orderpriority = '2-HIGH'")
        .join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    )
    lines = bridge.star(spark, SF, "lineitem")
    left = filters.only_keys(lines, "l_orderkey", picked, "o_orderkey")
    want = lines.join(picked, F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert 0 < left.count() == want < lines.count() / 10
    # The reduction is below the aggregation by order.
    text = bridge.crm_funnel(spark, SF, params=params)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[l_orderkey[\s\S]*Join LeftSemi", text)


def test_shop_and_media_come_from_one_scan(spark):
    cube = bridge.line_cube(spark, SF, ("region",))
    assert len(scans(cube, "l_extendedprice")) == 1
    for name in ("kpi_summary", "context_metrics"):
        assert len(scans(QUERIES[name](spark, SF), "l_extendedprice")) == 0  # from the pinned cube


@pytest.mark.parametrize("dims", [(), ("region",), ("region", "store_format", "category")])
def test_the_cube_gives_both_tables(spark, dims):
    shop, media = bridge.offline_and_media(spark, SF, dims, "1995-06-01", "1997-01-15")
    for got, want in ((shop, bridge.offline_sales(spark, SF, dims, "1995-06-01", "1997-01-15")), (media, bridge.media_spend(spark, SF, "1995-06-01", "1997-01-15"))):
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_line_without_a_part_is_sold_but_not_advertised(spark, tmp_path):
    for name in ("lineitem", "part", "supplier", "nation", "region"):
        df = bridge.star(spark, SF, name)
        df.filter("p_partkey > 20" if name == "part" else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    shop, media = bridge.offline_and_media(spark, str(tmp_path))
    for got, want in ((shop, bridge.offline_sales(spark, str(tmp_path), ())), (media, bridge.media_spend(spark, str(tmp_path)))):
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_account_tables_read_the_orders_once(spark):
    months = bridge.customer_months(spark, SF)
    deals = bridge.account_deals(spark, SF, months)
    assert scans(deals, "o_totalprice") == [] and scans(bridge.account_revenue(deals, months, bridge.account_as_of(months)), "o_totalprice") == []
