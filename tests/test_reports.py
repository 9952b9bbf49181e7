"""Reports that are committed together, rejects, monthly channel sets, hot applications, long all-months tables."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from compare import duck
from dealerflow import jobs
from dealerflow.operators import cells
from dealerflow.params import ReportParams
from dealerflow.plans import brand, channel_months, kpis
from dealerflow.plans.funnel import funnel
from dealerflow.sinks import reports
from dealerflow.sources import rejects as rejected
from dealerflow.sources import tpch_extracts as src
from frames import dicts, frame
from test_funnel import random_tables
from test_plans import conf, explain  # noqa: F401

P = ReportParams(as_of=date(2025, 3, 15), brand="A")


# --- staged and committed writes ------------------------------------------------


def tables_of(spark, number):
    return {name: spark.createDataFrame([(number, name)], "n int, name string") for name in ("first", "second")}


def numbers(spark, folder, through_marker=True):
    day = P.as_of
    paths = [reports.report_path(spark, folder, day, n) if through_marker else f"{reports.run_folder(folder, day)}/{n}" for n in ("first", "second")]
    return [spark.read.parquet(path).first().n for path in paths]


def test_a_failed_second_table_leaves_the_old_pair(spark, tmp_path):
    folder = str(tmp_path)
    reports.write_report(tables_of(spark, 1), folder, P)
    broken = tables_of(spark, 2)
    broken["second"] = broken["second"].withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        reports.write_report(broken, folder, P)
    assert numbers(spark, folder) == numbers(spark, folder, through_marker=False) == [1, 1]
    reports.write_report(tables_of(spark, 3), folder, P)
    assert numbers(spark, folder) == numbers(spark, folder, through_marker=False) == [3, 3]
    left = [p.name for p in (tmp_path / "run_date=2025-03-15").iterdir()]
    assert sorted(left) == ["first", "second"]


@pytest.mark.parametrize("moved", [0, 1])
def test_a_commit_that_was_not_moved_is_read_and_finished(spark, tmp_path, monkeypatch, moved):
    folder = str(tmp_path)
    reports.write_report(tables_of(spark, 1), folder, P)
    move, done = reports.Folder.move, []

    def stop(self, name, to):
        if len(done) == moved:
            raise OSError("lost")
        done.append(name)
        move(self, name, to)

    with monkeypatch.context() as m:
        m.setattr(reports.Folder, "move", stop)
        with pytest.raises(OSError, match="lost"):
            reports.write_report(tables_of(spark, 2), folder, P)
    assert numbers(spark, folder) == [2, 2]
    reports.publish(spark, folder, P.as_of)
    assert numbers(spark, folder, through_marker=False) == [2, 2]


def test_working_tables_are_read_once_and_not_published(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    source = spark.createDataFrame([(k,) for k in range(5)], "n long")
    work = spark.createDataFrame(source.rdd.mapPartitions(count), source.schema)
    sheets = {"sum": lambda t: t["w"].agg(F.sum("n").alias("n")), "max": lambda t: t["w"].agg(F.max("n").alias("n"))}
    paths = reports.write_report(sheets, str(tmp_path), P, work={"w": work})
    assert [spark.read.parquet(paths[n]).first().n for n in ("sum", "max")] == [10, 4]
    assert seen.value == 5
    assert sorted(p.name for p in (tmp_path / "run_date=2025-03-15").iterdir()) == ["max", "sum"]


# --- rejects ----------------------------------------------------------------------


def store_file(folder, rows, name="part.csv"):
    folder.mkdir(parents=True, exist_ok=True)
    headers = list(jobs.EXTRACTS["brand_stores"].headers)
    (folder / name).write_text("\n".join([",".join(headers), *rows]) + "\n", encoding="utf-8")
    return len(headers)


def test_one_bad_row_among_many_is_set_aside(spark, tmp_path):
    inbox, landed, one = str(tmp_path / "inbox"), str(tmp_path / "landed"), ["brand_stores"]
    width = len(jobs.EXTRACTS["brand_stores"].headers)
    good = [",".join([f"A{k}", f'"name, {k}"', *["x"] * (width - 2)]) for k in range(200)]
    short, long = "only", ",".join(["y"] * (width + 2))
    store_file(tmp_path / "inbox" / "brand_stores", [*good[:70], short, *good[70:]])
    store_file(tmp_path / "inbox" / "brand_stores", [long], "late.csv")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        jobs.land_extracts(spark, inbox, landed, one)
    with pytest.raises(rejected.TooManyRejects, match="2 malformed rows, 1 allowed"):
        jobs.land_extracts(spark, inbox, landed, one, max_rejects=1)
    assert not list((tmp_path / "landed" / "brand_stores").glob("*.parquet"))
    jobs.land_extracts(spark, inbox, landed, one, max_rejects=2)
    assert spark.read.parquet(f"{landed}/brand_stores").count() == 200
    aside = {r.row_text: (r.file.split("/")[-1], r.reason) for r in spark.read.parquet(f"{landed}/_rejects/brand_stores").collect()}
    assert aside == {short: ("part.csv", f"1 cells, {width} expected"), long: ("late.csv", f"{width + 2} cells, {width} expected")}


def test_rows_without_a_fault_leave_no_rejects(spark, tmp_path):
    width = len(jobs.EXTRACTS["brand_stores"].headers)
    store_file(tmp_path / "inbox" / "brand_stores", [",".join(["A", '"say ""hi"", all"', *["x"] * (width - 2)])])
    rows, aside = rejected.split_rejects(spark, jobs.EXTRACTS["brand_stores"], str(tmp_path / "inbox" / "brand_stores"))
    assert rows.count() == 1 and aside.isEmpty()
    assert "say \"hi\", all" in tuple(rows.first())


# --- monthly channel sets -----------------------------------------------------------


def test_merged_months_equal_the_single_pass(spark, sf_dir, tmp_path):
    contracts, p = src.contracts(spark, sf_dir, with_part=False), src.PARAMS
    months = [f"1995{m:02d}" for m in range(1, 13)] + [p.month]
    for k in range(0, len(months), 5):  # stored in three turns
        path = channel_months.store_channel_months(contracts, str(tmp_path), months[k : k + 5])
    sets = spark.read.parquet(path)
    assert {r[0] for r in sets.select("eff_month").distinct().collect()} == {int(m) for m in months}
    for merged, single in (
        (channel_months.merged_active_year(sets, p), kpis.active_channels_year(contracts, p)),
        (channel_months.merged_active_score(sets, p), kpis.active_store_score(contracts, p)),
    ):
        assert dicts(merged) == dicts(single) and merged.count() > 5


def test_a_month_stored_again_is_replaced(spark, tmp_path):
    first = frame(spark, "contract", {"channel_id": "a"}, {"channel_id": None}, {"eff_date": date(2025, 2, 1)}, {"eff_date": None})
    path = channel_months.store_channel_months(first, str(tmp_path))
    assert spark.read.parquet(path).count() == 3
    channel_months.store_channel_months(frame(spark, "contract", {"channel_id": "b"}), str(tmp_path), ["202503"])
    got = spark.read.parquet(path).select("channel_id", "eff_month").collect()
    assert sorted(map(tuple, got)) == [("b", 202503), ("channel_id", 202502)]


# --- hot applications ---------------------------------------------------------------


def test_hot_applications_are_counted(spark):
    preapps = frame(spark, "preapp", *[{"app_id": k} for k in [1] * 10 + [2] * 4 + [3] + [None] * 20])
    assert cells.hot_applications(preapps, 3) == [(1, 4), (2, 2)]
    assert cells.hot_applications(preapps, 10) == []


def test_the_list_of_hot_applications_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(cells, "MOST_HOT", 2)
    preapps = frame(spark, "preapp", *[{"app_id": k} for k in [1] * 16 + [2] * 6 + [3] * 5 + [4] * 2])
    assert cells.hot_applications(preapps, 1) == [(1, 2)]  # at 2 and at 4 there are three of them


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_applications_give_the_same_funnel(spark, seed):
    preapps, contracts = random_tables(spark, seed)
    hot = cells.hot_applications(preapps, 5)
    assert len(hot) > 2
    assert dicts(funnel(preapps, contracts, hot=hot)) == dicts(funnel(preapps, contracts))


def test_a_hot_application_is_spread_without_the_adaptive_split(spark, conf, tmp_path):  # noqa: F811
    """A third of the rows with one id, adaptive execution off: no task of the join gets more than its share."""
    conf(adaptive__enabled="false", autoBroadcastJoinThreshold="-1", shuffle__partitions="16")
    n = 30000
    one = frame(spark, "preapp", {}).drop("app_id", "product")
    ids = F.when(F.col("id") < n // 3, F.lit(7)).otherwise(F.col("id"))
    rows = spark.range(0, n, 1, 8).select(ids.alias("app_id"), F.md5(F.col("id").cast("string")).alias("product"))
    rows.crossJoin(F.broadcast(one)).write.parquet(str(tmp_path / "p"))
    preapps = spark.read.parquet(str(tmp_path / "p"))
    contracts = frame(spark, "contract", *[{"app_id": i} for i in (7, 7, 20000)])
    sizes = {}
    for name, hot in (("plain", ()), ("spread", cells.hot_applications(preapps, 500))):
        joined = cells.weigh_preapprovals(preapps, contracts, hot=hot)
        assert joined.agg(F.sum("copies")).first()[0] == n + n // 3
        assert re.search(r"(SortMergeJoin|ShuffledHashJoin) .*LeftOuter", explain(joined, "simple"))
        sizes[name] = max(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert sizes["plain"] > n // 3 and sizes["spread"] < 2.5 * n / 16


# --- all months ---------------------------------------------------------------------


def test_long_form_widened_equals_the_table(spark, sf_dir):
    inputs = (src.preapprovals(spark, sf_dir), src.contracts(spark, sf_dir), src.stores(spark, sf_dir), src.channels(spark, sf_dir))
    long = brand.brand_months(*inputs, src.PARAMS).cache()
    months = brand.months_of(long)
    assert len(months) > 12 and [m for m in months if m] == sorted(m for m in months if m)
    assert dicts(brand.widen(long)) == dicts(brand.brand_all_months(*inputs, src.PARAMS, months))
    levels = {(r.eff_cnt, r.level) for r in long.filter(F.col("month").isNotNull()).collect()}
    assert levels and all(level == (1 if n <= 1 else 2 if n <= 2 else 3) for n, level in levels)
    none = long.filter(F.col("eff_cnt").isNull())
    assert none.filter("month is not null or level is not null or brand is not null").isEmpty()
    long.unpersist()


def test_fixed_and_open_months_agree_where_both_have_them(spark, sf_dir):
    """The registered twin with its list of months against the one whose months come from the data."""
    from oracle.sql import FIXED_MONTHS, QUERIES

    con = duck(sf_dir)
    for name in FIXED_MONTHS:
        fixed, open_ = con.execute(FIXED_MONTHS[name]).df(), con.execute(QUERIES[name]).df()
        assert set(open_.columns) <= set(fixed.columns) and len(fixed) == len(open_)
        assert fixed.drop(columns=open_.columns).isna().all(axis=None)


def test_all_months_read_the_facts_once(spark, sf_dir, conf):  # noqa: F811
    conf(adaptive__enabled="false")
    inputs = (src.preapprovals(spark, sf_dir), src.contracts(spark, sf_dir), src.stores(spark, sf_dir), src.channels(spark, sf_dir))
    for table in (brand.brand_months(*inputs, src.PARAMS), brand.brand_all_months(*inputs, src.PARAMS, src.MONTHS)):
        plan = explain(table, "simple")
        assert plan.count("FileScan parquet [l_") == 2  # pre-approvals and contracts
    stacked = brand.stack_brands([inputs[2].filter("brand = 'Brand#1'"), inputs[2].filter("brand = 'Brand#2'").select("position", "address", "brand", "store_name")])
    assert stacked.columns == inputs[2].columns and {r[0] for r in stacked.select("brand").distinct().collect()} == {"Brand#1", "Brand#2"}
