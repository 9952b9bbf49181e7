"""Brand reports on hand rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from dealerflow import ReportParams
from dealerflow.functions import vocabulary as words
from dealerflow.operators.cells import FUNNEL_KEYS
from dealerflow.plans import brand
from dealerflow.plans.funnel import funnel
from frames import dicts, frame
from test_funnel import random_tables

P = ReportParams(as_of=date(2025, 3, 15), brand="A")


@pytest.fixture(scope="module")
def tables(spark):
    preapps, contracts = random_tables(spark, 11)
    stores = frame(
        spark, "store", {"brand": "A", "store_name": "one"}, {"brand": "A", "store_name": "two"},
        {"brand": "A", "store_name": "nobody"}, {"brand": "B", "store_name": "one"},
        {"brand": "A", "store_name": None},
    )
    channels = frame(
        spark, "channel", {"entity_name": "one", "channel_id": "1"}, {"entity_name": "one", "channel_id": "9"},
        {"entity_name": "two", "channel_id": "2"}, {"entity_name": None, "channel_id": "7"},
    )
    return preapps, contracts, stores, channels


def test_a_store_may_have_several_channels_or_none(spark, tables):
    got = dicts(brand.brand_stores(*tables[2:]), "brand", "store_name", "channel_id")
    assert [tuple(r.values()) for r in got] == [
        ("A", None, "7"), ("A", "nobody", None), ("A", "one", "1"), ("A", "one", "9"), ("A", "two", "2"),
        ("B", "one", "1"), ("B", "one", "9"),
    ]


def test_brand_lists_stack_by_name(spark):
    first = frame(spark, "store", {"brand": "A"})
    second = frame(spark, "store", {"brand": "B", "store_name": "x"}).select("address", "store_name", "brand")
    third = frame(spark, "store", {"brand": "B", "store_name": "y"})
    stacked = brand.stack_brands([first, second, third])
    assert [r["store_name"] for r in dicts(stacked)] == ["store", "x", "y"]
    assert sorted(r.brand for r in brand.brand_choices(stacked).collect()) == ["A", "B"]


def test_brand_order_of_first_appearance(spark):
    rows = spark.createDataFrame([("B", 1), ("A", 2), ("B", 3), ("A", 4)], "brand string, position int")
    ordered = brand.brand_choices(rows).orderBy("first_position")
    assert [r.brand for r in ordered.collect()] == ["B", "A"]


def test_amounts_are_rounded_per_cell_before_the_sum(spark):
    cells = funnel(
        frame(spark, "preapp", {"brand": "Z"}),
        frame(spark, "contract", {"fin_amt": 0.5, "product": "x"}, {"fin_amt": 0.5, "product": "y"},
              {"fin_amt": 1.5, "product": "z"}),
    )
    got = dicts(brand.channel_month(cells.filter(F.col("brand") == "B")), "eff_cnt", "eff_amt", "preapp_cnt")
    assert got == [{"eff_cnt": 3, "eff_amt": 2.0, "preapp_cnt": 0}]


def test_a_cell_with_an_open_decision_adds_no_passes(spark):
    preapps = frame(
        spark, "preapp", {"auto_result": words.PASS, "product": "x"},
        {"auto_result": words.PASS, "auto_ts": None, "product": "y"},
        {"auto_result": words.PASS, "product": "y"},
    )
    cells = funnel(preapps, frame(spark, "contract", {"brand": "Z", "app_id": 7}))
    got = dicts(brand.channel_month(cells.filter(F.col("brand") == "B")), "apply_cnt", "apply_pass")
    assert got == [{"apply_cnt": 3, "apply_pass": 1}]


def test_month_report_has_every_store_and_a_total(tables):
    detail = brand.brand_month_detail(*tables, P)
    report = brand.brand_month_report(*tables, P)
    rows = dicts(detail)
    # The store without a channel also has no channel id and takes the measures of missing channels.
    assert sorted((str(r["store_name"]), str(r["channel_id"])) for r in rows) == [
        ("None", "7"), ("nobody", "None"), ("one", "1"), ("one", "9"), ("two", "2"),
    ]
    unmatched = [r for r in rows if r["channel_id"] in ("7", "9")]
    assert all(r["brand"] is None and r["month"] is None and r["eff_cnt"] is None for r in unmatched)
    total = [r for r in dicts(report) if r["channel_id"] == words.TOTAL_LABEL]
    assert len(total) == 1
    assert report.count() == len(rows) + 1
    for name in [*brand.COUNTS, "eff_amt"]:
        assert total[0][name] == sum(r[name] or 0 for r in rows if r["brand"] is not None), name
    assert total[0]["month"] == "202502"
    assert total[0]["brand"] == "A"
    assert all(total[0][n] is None for n in ("store_name", "address", "owner", "supervisor", "channel_status"))


def test_missing_channels_match_missing_channels(tables):
    row = [r for r in dicts(brand.brand_month_detail(*tables, P)) if r["store_name"] == "nobody"]
    assert row[0]["brand"] == "A" and row[0]["preapp_cnt"] > 0


def test_no_total_without_matching_rows(tables):
    empty = ReportParams(as_of=date(2020, 1, 1), brand="A")
    report = brand.brand_month_report(*tables, empty)
    assert report.filter(F.col("channel_id") == words.TOTAL_LABEL).count() == 0
    assert report.count() == 5


def pivot_by_cells(tables, months):
    """The pivot through the full funnel, as a group, a join and a pivot."""
    preapps, contracts, stores, channels = tables
    measures = brand.channel_month(funnel(preapps, contracts).filter(F.col("brand") == "A"))
    listed = brand.brand_stores(stores.filter(F.col("brand") == "A"), channels).drop("brand")
    joined = listed.join(
        measures.withColumnRenamed("channel_id", "c"), F.col("channel_id").eqNullSafe(F.col("c")), "left"
    )
    return joined.groupBy("brand", *brand.STORE_COLUMNS).pivot("month", months).agg(F.max("eff_cnt"))


def test_pivot_equals_the_way_through_the_cells(tables):
    months = ["202502", "202503", "202504"]
    direct = brand.brand_all_months(*tables, P, months)
    names = ["brand", *brand.STORE_COLUMNS, *months]
    assert dicts(direct, *names) == dicts(pivot_by_cells(tables, months), *names)


def test_pivot_without_months_takes_them_from_the_data(tables):
    got = brand.brand_all_months(*tables, P)
    assert got.columns[-3:] == ["202502", "202503", brand.NO_MONTH]
    assert brand.month_columns(got) == ["202502", "202503"]
    by_store = {r["store_name"]: r for r in dicts(got)}
    assert by_store["two"][brand.NO_MONTH] == 0


def test_month_without_effective_contract_is_zero_and_without_cell_is_missing(spark):
    stores, channels = frame(spark, "store", {}), frame(spark, "channel", {})
    preapps = frame(spark, "preapp", {"preapp_date": date(2025, 1, 1)})
    contracts = frame(spark, "contract", {})
    p = ReportParams(as_of=date(2025, 3, 15), brand="B")
    got = brand.brand_all_months(preapps, contracts, stores, channels, p, ["202501", "202503", "202504"])
    row = got.first()
    assert (row["202501"], row["202503"], row["202504"]) == (0, 1, None)


def test_reports_of_all_brands_equal_single_reports(tables):
    together = dicts(brand.brand_month_reports(*tables, P))
    months = ["202502", "202503"]
    pivots = dicts(brand.brand_all_months_tables(*tables, months))
    for name in ("A", "B"):
        p = ReportParams(as_of=P.as_of, brand=name)
        own = [{k: v for k, v in r.items() if k != "report_brand"} for r in together if r["report_brand"] == name]
        assert own == dicts(brand.brand_month_report(*tables, p))
        own = [{k: v for k, v in r.items() if k != "report_brand"} for r in pivots if r["report_brand"] == name]
        assert own == dicts(brand.brand_all_months(*tables, p, months))
    assert {r["report_brand"] for r in together} == {"A", "B"}


def test_levels(spark):
    table = spark.createDataFrame(
        [("a", 0, 5), ("b", 1, None), ("c", 2, 3), ("d", 3, 2)], "brand string, `202501` long, x long"
    )
    got = dicts(brand.brand_month_levels(table))
    assert [(r["202501"], r["x"]) for r in got] == [(1, 5), (1, None), (2, 3), (3, 2)]


def test_store_columns_do_not_hide_keys():
    assert "channel_id" in brand.STORE_COLUMNS and "channel_id" in FUNNEL_KEYS
