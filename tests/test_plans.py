"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dealerflow.operators import cells
from dealerflow.plans import brand, funnel, kpis, scorecard
from dealerflow.sources import tpch_extracts as src
from dealerflow.sources.landing import land, read_landed
from frames import frame


def explain(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def change(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


REMOVABLE = {"pipeline", *entry.llm_queries.QUERIES} if entry.llm_queries else set()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - REMOVABLE))
def test_no_python_no_cross_product_no_row_limits(spark, sf_dir, name):
    plan = explain(entry.queries()[name](spark, sf_dir))
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Sample" not in plan
    limited = "TakeOrderedAndProject" in plan or "Limit" in plan
    assert limited == bool(re.search(r"top\d+$", name))


def test_scans_read_only_the_columns_in_use(spark, sf_dir):
    plan = explain(kpis.lcv_score(src.contracts(spark, sf_dir, with_part=False), src.PARAMS))
    schema = re.search(r"ReadSchema: (struct<l_orderkey.*?>)", plan).group(1)
    assert "l_partkey" not in schema and "l_extendedprice" not in schema and "l_tax" not in schema
    assert "GreaterThanOrEqual(l_discount,0.05)" in plan
    assert "p_partkey" not in plan


def test_scorecard_scans_the_contracts_once(spark, sf_dir, conf):
    conf(adaptive__enabled="false")
    plan = explain(entry.queries()["scorecard"](spark, sf_dir), "simple")
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1


def test_null_safe_keys_are_shuffled_like_equal_ones(spark, conf):
    conf(autoBroadcastJoinThreshold="-1")
    joined = cells.weigh_preapprovals(frame(spark, "preapp", {}), frame(spark, "contract", {}))
    plan = explain(joined)
    assert "SortMergeJoin LeftOuter" in plan
    assert "hashpartitioning(coalesce(app_id" in plan


def test_funnel_shuffles_once_after_the_lookup(spark, conf):
    conf(adaptive__enabled="false", autoBroadcastJoinThreshold="-1")
    plan = explain(funnel.funnel(frame(spark, "preapp", {}), frame(spark, "contract", {})), "simple")
    # Both sides of the lookup join, the counts before it, and the cells.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4
    assert plan.count("SortMergeJoin") == 1


def test_month_filter_reaches_every_scan(spark, tmp_path):
    paths = {}
    for kind in ("preapp", "contract"):
        frame(spark, kind, {}, {}).write.parquet(str(tmp_path / kind))
        paths[kind] = spark.read.parquet(str(tmp_path / kind))
    plan = explain(funnel.funnel(paths["preapp"], paths["contract"], "B", "202503"))
    pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", plan)
    months = [p for p in pushed if "202503" in p]
    assert len(months) == 3 and all("EqualTo(brand,B)" in p for p in months)


def test_month_lookup_is_reduced_to_the_month_before_it_is_counted(spark, tmp_path, conf):
    paths = {}
    for kind in ("preapp", "contract"):
        frame(spark, kind, {}, {}).write.parquet(str(tmp_path / kind))
        paths[kind] = spark.read.parquet(str(tmp_path / kind))
    conf(adaptive__enabled="false")
    plan = explain(funnel.funnel(paths["preapp"], paths["contract"], None, "202503"), "simple")
    counted = plan[plan.index("LeftOuter"):]
    assert counted.index("HashAggregate") < counted.index("LeftSemi")
    # Broadcast ids: the contracts are not shuffled before they are reduced and counted.
    reduced = counted[counted.index("LeftSemi"):]
    assert "BroadcastHashJoin" in counted[: counted.index("LeftSemi") + 1]
    assert "Exchange hashpartitioning" not in reduced[: reduced.index("FileScan")]


def test_report_and_total_share_one_shuffle(spark, sf_dir, conf):
    conf(adaptive__enabled="false")
    plan = explain(entry.queries()["brand_month_report"](spark, sf_dir), "simple")
    assert re.search(r"ReusedExchange \[brand#\d+, month#\d+, channel_id\w*#\d+", plan)


def test_pivot_needs_no_lookup_join(spark, conf):
    conf(adaptive__enabled="false", autoBroadcastJoinThreshold="-1")
    tables = [frame(spark, kind, {}) for kind in ("preapp", "contract", "store", "channel")]
    p = src.PARAMS
    plan = explain(brand.brand_all_months(*tables, p, [f"1996{m:02d}" for m in range(1, 13)]), "simple")
    assert not re.search(r"Join \[[^\]]*app_id", plan)
    assert len(re.findall(r"(?:Join|Aggregate) ?[\[(]", plan)) > 0


def test_store_list_can_be_broadcast_whatever_the_channels(spark, conf, tmp_path):
    # Below the size of the channel side, above that of the stores.
    conf(autoBroadcastJoinThreshold="20000", adaptive__enabled="false")
    frame(spark, "store", {}).write.parquet(str(tmp_path / "s"))
    stores = spark.read.parquet(str(tmp_path / "s"))
    channels = spark.range(100000).select(
        F.col("id").cast("string").alias("entity_name"), F.col("id").cast("string").alias("channel_id"),
        F.lit("o").alias("owner"), F.lit("s").alias("supervisor"), F.lit("x").alias("channel_status"),
    )
    plan = explain(brand.brand_stores(stores, channels), "simple")
    assert "BroadcastHashJoin" in plan and "Inner, BuildLeft" in plan


@pytest.mark.parametrize("join,hash_up_to", [("SortMergeJoin", "0"), ("ShuffledHashJoin", "64MB")])
def test_a_hot_application_id_is_split(spark, conf, tmp_path, join, hash_up_to):
    """One id on a third of the pre-approvals: its partition is cut into several."""
    conf(
        adaptive__maxShuffledHashJoinLocalMapThreshold=hash_up_to,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="64KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="64KB",
        adaptive__coalescePartitions__enabled="false",
    )
    n = 60000
    ids = F.when(F.col("id") < n // 3, F.lit(7)).otherwise(F.col("id"))
    one = frame(spark, "preapp", {}).drop("app_id")
    preapps = spark.range(0, n, 1, 8).select(ids.alias("app_id"), F.md5(F.col("id").cast("string")).alias("noise"))
    preapps = preapps.crossJoin(F.broadcast(one)).withColumn("product", F.col("noise")).drop("noise")
    preapps.write.parquet(str(tmp_path / "p"))
    contracts = frame(spark, "contract", *[{"app_id": i} for i in (7, 7, 7, 30000)])
    rows = cells.weigh_preapprovals(spark.read.parquet(str(tmp_path / "p")), contracts)
    joined = rows.select(F.sum("copies").alias("all"), F.count("*").alias("n"), F.max("product"))
    got = joined.collect()[0]
    assert (got["n"], got["all"]) == (n, n + 2 * (n // 3))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert f"{join}(skew=true)" in plan


def test_ranks_see_one_row_per_manager(spark, sf_dir):
    """The only single-partition steps come after grouping by manager or supervisor."""
    contracts = src.contracts(spark, sf_dir, with_part=False)
    card = scorecard.scorecard(contracts, src.channels(spark, sf_dir), src.roster(spark, sf_dir), src.PARAMS)
    lines = explain(card, "simple").splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = "\n".join(lines[i + 1:])
            first = re.search(r"(HashAggregate|FileScan)[^\n]*", below).group(0)
            assert re.match(r"HashAggregate\(keys=\[(manager_id|supervisor_id)", first), first


def test_a_hot_month_is_landed_in_several_files(spark, conf, tmp_path):
    """Half of the rows in one month: that month is cut up into files of their own."""
    conf(adaptive__advisoryPartitionSizeInBytes="64KB")
    one = frame(spark, "contract", {}).drop("app_id", "eff_month", "customer_name")
    month = F.when(F.col("id") % 2 == 0, 202503).otherwise(202401 + (F.col("id") % 9).cast("int"))
    rows = spark.range(0, 40000, 1, 8).select(
        F.col("id").alias("app_id"), month.alias("eff_month"), F.sha2(F.col("id").cast("string"), 256).alias("customer_name")
    ).crossJoin(F.broadcast(one))
    land(rows, "contracts", str(tmp_path))
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "contracts").glob("eff_month=*")}
    assert len(files) == 10
    assert files["eff_month=202503"] > 5
    # Fewer than one file per task and month; a month may share a split partition.
    assert sum(files.values()) < 8 * 10
    assert min(files.values()) < 5
    assert read_landed(spark, rows, "contracts", str(tmp_path)).count() == 40000
