"""Every registered report against its DuckDB statement on the sf0.001 data,
"""

import datetime as dt
import decimal
import math
import os
import re

import pytest

import __spark_entry__ as entry_mod
from ledgerlens import registry
from ledgerlens.operators import daily, receivables, sales
from ledgerlens.plans import base as B
from ledgerlens.sources.tables import read_parquet_tables, write_parquet_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def _canon(rows, cols, names):
    return sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert _canon([tuple(r) for r in df.collect()], cols, df.columns) == _canon(rel.fetchall(), cols, rel.columns)


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
    assert "r22_daily_report" in entry_mod.queries()


def _all_plans(spark):
    for name, fn in registry.QUERIES.items():
        yield name, fn(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_no_cartesian(spark):
    for name, plan in _all_plans(spark):
        for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_board_reads_history_once(spark, tmp_path):
    root = str(tmp_path / "star")
    write_parquet_tables(registry.tables_for(spark, SF), root)
    t = read_parquet_tables(spark, root)
    from ledgerlens.operators import delivery
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = delivery.delivery_board(t, registry.AS_OF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    scans = re.findall(r"FileScan parquet[^\n]*document_status_history", plan)
    assert len(scans) == 1
    # the date filter of the board reaches the voucher scan
    assert re.search(r"FileScan parquet[^\n]*vouchers[^\n]*PushedFilters: \[[^\]]*transaction_date", plan)


def test_properties(spark):
    t = registry.tables_for(spark, SF)
    lo, hi = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
    by_day = sales.sales_trend(t, lo, hi, "daily").collect()
    by_month = {r["date"]: r["total_sales"] for r in sales.sales_trend(t, lo, hi, "monthly").collect()}
    months = {}
    for r in by_day:
        k = r["date"].replace(day=1)
        months[k] = months.get(k, 0.0) + r["total_sales"]
    assert months.keys() == by_month.keys()
    assert all(abs(months[k] - by_month[k]) < 1e-4 for k in months)

    # R3 over sites == R1 (every site id resolves in the test data)
    r1 = sum(r["sales"] for r in sales.sales_summary(t, registry.AS_OF).collect())
    r3 = sum(r["total_amount"] for r in sales.sales_by_site(t, registry.AS_OF).collect())
    assert abs(r1 - r3) < 1e-6

    # R6 total == R19 total
    r6 = sum(r["outstanding"] for r in receivables.ar_aging(t, registry.AS_OF).collect())
    r19 = receivables.outstanding_summary(t).first()["total"]
    assert abs(r6 - r19) < 1e-4

    # rollup == sum of its breakdown; hero revenue >= sum over sites
    hero = {r["report_date"]: r["revenue"] for r in daily.daily_hero(t).collect()}
    per_day = {}
    for s in daily.site_revenue(t).collect():
        assert abs(s["total_revenue"] - sum(b["revenue"] for b in s["breakdown"])) < 1e-6
        assert s["invoice_count"] == sum(b["invoice_count"] for b in s["breakdown"])
        per_day[s["report_date"]] = per_day.get(s["report_date"], 0.0) + s["total_revenue"]
    assert all(hero[d] + 1e-6 >= v for d, v in per_day.items())


def test_milestones_subset_equals_full(spark):
    t = registry.tables_for(spark, SF)
    ids = t.vouchers.filter("transaction_date >= date'2001-01-01'").select("id")
    sub = {r["voucher_id"]: r for r in B.milestones(t, ids).collect()}
    full = {r["voucher_id"]: r for r in B.milestones(t).join(ids.withColumnRenamed("id", "voucher_id"),
                                                              "voucher_id", "left_semi").collect()}
    assert sub == full and len(sub) > 0


@pytest.fixture(scope="module")
def stored_star(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("star") / "star")
    write_parquet_tables(registry.tables_for(spark, SF), root)
    return read_parquet_tables(spark, root)


def _full_text(df):
    """The plan text of ``df`` after execution, without cut-off lists."""
    spark = df.sparkSession
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan = plan.executedPlan()
        return plan.toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)


def _scans(plan, table):
    return len(re.findall(rf"FileScan parquet[^\n]*/{table}[/\],]", plan))


def test_followup_reads_the_orders_once(spark, stored_star):
    # R9 runs over (customer, day, branch) cells on one partitioning by
    # customer; the raw orders are scanned once and never meet a window.
    from ledgerlens.operators import customers
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = customers.followup_customers(stored_star, registry.AS_OF)
        plan = _full_text(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert _scans(plan, "vouchers") == 1
    assert "row_number" not in plan and "Aggregate" in plan
    by_customer = re.findall(r"Exchange hashpartitioning\(party_id#\d+L?, \d+\)", plan)
    assert len(by_customer) == 2  # the cells and the listed customers, each once


def test_composite_reads_facts_once_per_theme(spark, stored_star):
    plan = _full_text(daily.daily_report(stored_star))
    # day totals (hero, sites, salesmen, collections in one aggregate), top
    # products, invoices with challans (twice), and the calendar's ends with the
    # outstanding sums read the vouchers; the history and the lines are read once
    assert _scans(plan, "vouchers") <= 5
    assert _scans(plan, "document_status_history") == 1
    assert _scans(plan, "voucher_items") == 1
    assert len(re.findall(r"Exchange rangepartitioning", plan)) <= 1


def test_scalars_of_the_composite_plan_no_list(spark, stored_star):
    plan = _full_text(daily.daily_report(stored_star, sections=()))
    assert _scans(plan, "document_status_history") == 0 and _scans(plan, "voucher_items") == 0
    assert "collect_list" not in plan and "collect_set" not in plan
    whole = daily.daily_report(stored_star, *registry.MONTH)
    some = daily.daily_report(stored_star, *registry.MONTH, sections=("top_products", "sites"))
    assert some.columns == [*registry._SCALARS, "sites", "top_products"]
    assert some.collect() == whole.select(*some.columns).collect()
    assert daily.daily_report(stored_star, *registry.MONTH, sections=()).collect() == whole.select(*registry._SCALARS).collect()
    with pytest.raises(ValueError):
        daily.daily_report(stored_star, sections=("profits",))


def _path_to(node, name, above=()):
    """Names of the physical operators from the root down to the scan of a table."""
    here = (*above, node.nodeName())
    if "FileScan" in node.toString().split("\n")[0] and f"/{name}" in node.toString().split("\n")[0]:
        return here
    children = node.children()
    for i in range(children.size()):
        if found := _path_to(children.apply(i), name, here):
            return found
    return None


@pytest.mark.parametrize("report", ["delivery_operations", "delivery_agents", "invoice_delivery"])
def test_a_window_reduces_the_history_ahead_of_its_aggregate(spark, stored_star, report):
    from ledgerlens.operators import delivery
    build = getattr(delivery, report)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        path = _path_to(build(stored_star, *registry.ONE_DAY)._jdf.queryExecution().sparkPlan(), "document_status_history")
        whole = _path_to(build(stored_star)._jdf.queryExecution().sparkPlan(), "document_status_history")
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    below = lambda p: p[max(i for i, n in enumerate(p) if "Aggregate" in n):]
    assert any("Join" in n for n in below(path)) and not any("Join" in n for n in below(whole))
    # and the invoices of the window are the same either way
    one = {r.voucher_id: r for r in delivery.invoice_delivery(stored_star, *registry.MONTH).collect()}
    every = {r.voucher_id: r for r in delivery.invoice_delivery(stored_star).filter(
        f"report_date BETWEEN date'{registry.MONTH[0]}' AND date'{registry.MONTH[1]}'").collect()}
    sort = lambda d: {k: {**r.asDict(), "agents": sorted(a.full_name or "" for a in r.agents)} for k, r in d.items()}
    assert one and sort(one) == sort(every)


def test_building_a_report_starts_no_job(spark):
    t = registry.tables_for(spark, SF)
    sc = spark.sparkContext
    sc.setJobGroup("build", "building reports only")
    try:
        for build in registry.REPORTS.values():
            build(t)
        assert not sc.statusTracker().getJobIdsForGroup("build")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_no_forced_broadcast(spark):
    for name, fn in registry.QUERIES.items():
        if re.match(r"r\d", name):
            logical = fn(spark, SF)._jdf.queryExecution().logical().toString()
            assert "strategy=broadcast" not in logical, name


@pytest.mark.parametrize("name", ["r04_sales_by_group_busy_day", "r09_followup_customers", "r11_delivery_board", "r15_salesman_revenue_month",
                                  "r20_delivery_operations_month", "r13_delivery_counts_month", "r21_delivery_agents_one_day", "r22_sites"])
def test_same_result_without_broadcasts(spark, duck, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        test_matches_oracle(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_as_of_defaults_to_today(spark):
    t = registry.tables_for(spark, SF)
    today = dt.date.today()
    from ledgerlens.operators import customers, delivery
    for report in (sales.sales_summary, sales.monthly_sales, receivables.ar_aging, receivables.at_risk_customers,
                   customers.followup_customers, customers.customer_locations, delivery.delivery_board):
        assert report(t).collect() == report(t, today).collect()


def test_empty_day_has_a_row_on_request(spark):
    from ledgerlens.operators import delivery
    t = registry.tables_for(spark, SF)
    day = dt.date(1970, 1, 1)
    assert [tuple(r) for r in daily.daily_hero(t, day, day, every_day=True).collect()] == [(day, 0.0, 0, 0.0, 0)]
    assert [tuple(r) for r in delivery.delivery_counts(t, day, day, every_day=True).collect()] == [(day, 0, 0)]
    assert daily.daily_hero(t, day, day).count() == 0


def test_new_customers_are_the_companion_of_the_composite(spark):
    from ledgerlens.operators import customers
    t = registry.tables_for(spark, SF)
    counts = {r["date"]: r["new_customer_count"] for r in daily.daily_report(t, *registry.MONTH).collect()}
    rows = {r["report_date"]: r["count"] for r in customers.new_customers(t, *registry.MONTH).groupBy("report_date").count().collect()}
    assert rows and {d: n for d, n in counts.items() if n} == rows


def test_jdbc_reads_every_large_table_in_slices():
    from ledgerlens.sources.tables import JDBC_SLICES, jdbc_options
    bounds = dict.fromkeys(JDBC_SLICES, (1, 10**9))
    assert set(JDBC_SLICES) == {"vouchers", "parties", "voucher_items", "delivery_challans", "document_status_history"}
    for t in JDBC_SLICES:
        assert jdbc_options(t, bounds, 32)["numPartitions"] == 32
        with pytest.raises(ValueError):
            jdbc_options(t, {}, 32)
    assert jdbc_options("sites", {}, 32) == {}


def test_top_products_limits_before_exchange(spark):
    plan = registry.QUERIES["r18_top_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_results_do_not_depend_on_session_zone(spark, duck):
    from ledgerlens.sources.tpch import star_from_tpch
    names = ["r09_followup_customers", "r11_delivery_board", "r11a_milestones", "r17_new_customers"]
    t = star_from_tpch(spark, SF)  # built under UTC ...
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # ... run elsewhere
    try:
        for name in names:
            df = registry.REPORTS[name](t)
            rel = duck.sql(registry.ORACLE_SQL[name])
            cols = sorted(df.columns)
            got = _canon([tuple(r) for r in df.collect()], cols, df.columns)
            assert got == _canon(rel.fetchall(), cols, rel.columns), name
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
