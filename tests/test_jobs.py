"""The batch jobs from CSV extracts to report folders."""

import pytest
from dataclasses import replace

from compare import duck, duck_rows, spark_rows
from dealerflow import jobs
from dealerflow.plans import brand
from dealerflow.session import MIB, initial_partitions
from dealerflow.sources import schemas
from dealerflow.sources import tpch_extracts as src
from oracle.sql import QUERIES
from test_sources import write_csv


def test_partitions_follow_the_shuffle_size():
    assert initial_partitions(10 * MIB, 8) == 8
    assert initial_partitions(1024 * 128 * MIB, 8) == 1024


def test_from_extracts_to_reports(spark, sf_dir, tmp_path):
    inbox, landed, out = (str(tmp_path / n) for n in ("inbox", "landed", "out"))
    tables = {
        "contracts": src.raw_contracts(spark, sf_dir, as_text=True),
        "preapprovals": src.raw_preapprovals(spark, sf_dir, as_text=True),
        "channels": src.raw_channels(spark, sf_dir, as_text=True),
        "roster": src.raw_roster(spark, sf_dir),
        "visits": src.raw_visits(spark, sf_dir),
        "brand_stores": src.stores(spark, sf_dir),
    }
    for name, table in tables.items():
        write_csv(table, schemas.EXTRACTS[name], f"{inbox}/{name}")
    assert len(jobs.land_extracts(spark, inbox, landed)) == 6
    card = jobs.run_scorecard(spark, landed, out, src.PARAMS)
    months = jobs.run_brand(spark, landed, out, src.PARAMS)
    months |= jobs.run_brands(spark, landed, out, src.PARAMS)
    con = duck(sf_dir)
    for path, query in (
        (card["scorecard"], "scorecard"), (card["overdue_detail"], "overdue_detail"),
        (months["brand_month_reports"], "brand_month_reports"),
        (months["brand_all_months_tables"], "brand_all_months_tables"),
        (months["brand_month_report"], "brand_month_report"), (months["brand_all_months"], "brand_all_months"),
    ):
        assert spark_rows(spark.read.parquet(path)) == duck_rows(con, QUERIES[query]), query
    assert months["brand_all_months"].endswith("brand=Brand#1/run_date=1996-03-15/brand_all_months")


def test_months_of_another_brand_come_from_the_data(spark, sf_dir, tmp_path):
    landed = str(tmp_path / "landed")
    for name, table in (
        ("contracts", src.contracts(spark, sf_dir)), ("preapprovals", src.preapprovals(spark, sf_dir)),
        ("channels", src.channels(spark, sf_dir)), ("brand_stores", src.stores(spark, sf_dir)),
    ):
        jobs.land(table, name, landed)
    paths = jobs.run_brand(spark, landed, str(tmp_path / "out"), replace(src.PARAMS, brand="Brand#7"), "csv")
    header = spark.read.option("header", True).csv(paths["brand_all_months"]).columns
    found = [c for c in header if len(c) == 6 and c.isdigit()]
    assert len(found) > 12
    paths = jobs.run_brands(spark, landed, str(tmp_path / "out"), replace(src.PARAMS, brand=None))
    months = brand.month_columns(spark.read.parquet(paths["brand_all_months_tables"]))
    assert set(found) <= set(months) and months == sorted(months)


def test_command_line(spark, sf_dir, tmp_path):
    inbox, landed, out = (str(tmp_path / n) for n in ("inbox", "landed", "out"))
    for name, table in (
        ("contracts", src.raw_contracts(spark, sf_dir, as_text=True)),
        ("preapprovals", src.raw_preapprovals(spark, sf_dir, as_text=True)),
        ("channels", src.raw_channels(spark, sf_dir, as_text=True)), ("roster", src.raw_roster(spark, sf_dir)),
        ("visits", src.raw_visits(spark, sf_dir)), ("brand_stores", src.stores(spark, sf_dir)),
    ):
        write_csv(table, schemas.EXTRACTS[name], f"{inbox}/{name}")
    jobs.main(["land", inbox, landed])
    jobs.main(["scorecard", landed, out, "--as-of", "1996-03-15", "--branch", "BRANCH_A", "--exclude", "NATION_3",
               "--customer-name", "drop"])
    jobs.main(["brand", landed, out, "--as-of", "1996-03-15", "--brand", "Brand#1"])
    jobs.main(["brand", landed, out, "--as-of", "1996-03-15"])
    day = "run_date=1996-03-15"
    card = spark.read.parquet(f"{out}/{day}/scorecard")
    assert card.count() > 10 and card.filter("manager = 'NATION_3'").isEmpty()
    assert "customer_name" not in spark.read.parquet(f"{out}/{day}/overdue_detail").columns
    one = spark.read.parquet(f"{out}/brand=Brand#1/{day}/brand_month_report")
    every = spark.read.parquet(f"{out}/{day}/brand_month_reports").filter("report_brand = 'Brand#1'")
    assert spark_rows(every.drop("report_brand")) == spark_rows(one)
    jobs.main(["brand", landed, f"{out}/chosen", "--as-of", "1996-03-15", "--brand", "Brand#1", "--label-month", "total",
               "--month", "199603", "--shuffle-bytes", str(64 * MIB)])
    day = f"{out}/chosen/brand=Brand#1/{day}"
    assert brand.month_columns(spark.read.parquet(f"{day}/brand_all_months")) == ["199603"]
    assert not spark.read.parquet(f"{day}/brand_month_report").filter("month = 'total'").isEmpty()
    jobs.main(["scorecard", landed, f"{out}/late", "--as-of", "1996-03-15", "--branch", "BRANCH_A", "--cutoff", "2030-01-01",
               "--prev", "add_months", "--year", "1995", "--partner", "5-LOW", "--blank-is-missing"])
    assert spark.read.parquet(f"{out}/late/run_date=1996-03-15/overdue_detail").isEmpty()
    before = spark.read.parquet(f"{landed}/visits").count()
    jobs.main(["refresh", inbox, landed, "--extract", "visits"])
    assert spark.read.parquet(f"{landed}/visits").count() == 2 * before


def test_line_breaks_in_cells_and_malformed_rows(spark, tmp_path):
    inbox = tmp_path / "inbox" / "brand_stores"
    inbox.mkdir(parents=True)
    headers = list(jobs.EXTRACTS["brand_stores"].headers)
    cells = ["A", "name", '"floor 1\nfloor 2"', *["x"] * (len(headers) - 3)]
    (inbox / "part.csv").write_text(",".join(headers) + "\n" + ",".join(cells) + "\n", encoding="utf-8")
    one = ["brand_stores"]
    jobs.land_extracts(spark, str(tmp_path / "inbox"), str(tmp_path / "landed"), one, multi_line=True)
    assert spark.read.parquet(str(tmp_path / "landed" / "brand_stores")).count() == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        jobs.land_extracts(spark, str(tmp_path / "inbox"), str(tmp_path / "other"), one)


def test_refresh_with_line_breaks_in_cells_and_malformed_rows(spark, tmp_path):
    inbox, landed, extract = tmp_path / "inbox" / "channels", str(tmp_path / "landed"), jobs.EXTRACTS["channels"]
    inbox.mkdir(parents=True)
    headers = list(extract.headers)
    address = next(i for i, name in enumerate(extract.headers.values()) if name in extract.text)

    def arrive(name, cell):
        cells = ["1"] * len(headers)
        cells[address] = cell
        (inbox / name).write_text(",".join(headers) + "\n" + ",".join(cells) + "\n", encoding="utf-8")

    arrive("first.csv", '"floor 1\nfloor 2"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        jobs.refresh(spark, extract, str(inbox), str(tmp_path / "other"))
    assert not list((tmp_path / "other").glob("channels/**/*.parquet"))
    for name in ("first.csv", "second.csv"):
        arrive(name, '"floor 1\nfloor 2"')
        jobs.main(["refresh", str(tmp_path / "inbox"), landed, "--extract", "channels", "--multi-line"])
    rows = spark.read.parquet(f"{landed}/channels").collect()
    assert len(rows) == 2 and all("floor 1\nfloor 2" in map(str, r.asDict().values()) for r in rows)
