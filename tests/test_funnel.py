"""Funnel cells: hand rows, and the stacked form against joins of three tables."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from dealerflow.functions import vocabulary as words
from dealerflow.functions.numbers import sum_or_zero
from dealerflow.operators import cells
from dealerflow.operators.joins import null_safe_join
from dealerflow.plans.funnel import funnel, funnel_top
from frames import KEYS, dicts, frame

MEASURES = ["preapp_cnt", "preapp_pass", "apply_cnt", "apply_pass", "eff_cnt", "eff_amt"]


def random_tables(spark, seed, n=120):
    rng = random.Random(seed)
    days = [date(2025, 2, 27), date(2025, 3, 1), date(2025, 3, 31), None]
    ids = [None, 1, 1, 1, 2, 3, 4, 5, 6, 7]

    def keys():
        return {
            "brand": rng.choice(["A", "B", None]),
            "channel_id": rng.choice(["1", "2", None]),
            "manager": rng.choice(["m", None]),
        }

    contracts = [keys() | {
        "app_id": rng.choice(ids), "eff_date": rng.choice(days), "prod_class": rng.choice(["p", "q", None]),
        "app_status": rng.choice(["ok", words.CANCELLED, None]), "fin_amt": rng.choice([0.5, 1.5, 2.25, None]),
    } for _ in range(n)]
    preapps = [keys() | {
        "app_id": rng.choice(ids), "preapp_date": rng.choice(days), "apply_date": rng.choice(days),
        "preapp_result": rng.choice([words.AUTO_PASS, "x", None]),
        "manual_ts": rng.choice(["", "2025-03-03 00:00:00", None]),
        "auto_ts": rng.choice(["2025-03-01 00:00:00", "2025-03-04 00:00:00"] * 4 + [None]),
        "manual_result": rng.choice([words.PASS, "x", None]),
        "auto_result": rng.choice([words.PASS, "x"]),
    } for _ in range(n)]
    return frame(spark, "preapp", *preapps), frame(spark, "contract", *contracts)


def sum_or_missing(x):
    """Sum that is missing as soon as one value of the group is."""
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def funnel_by_joins(preapps, contracts):
    """The same measures from row-level enrichment and two full outer joins."""
    rows = cells.enrich_preapprovals(preapps, contracts)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    label = lambda name: F.col(name).cast("string").alias("month")
    rest = cells.FUNNEL_KEYS[1:]
    pre = rows.select(label("preapp_month"), *rest, "preapp_result").groupBy(*cells.FUNNEL_KEYS).agg(
        F.count("*").alias("preapp_cnt"),
        F.sum(F.when(F.col("preapp_result") == words.AUTO_PASS, 1).otherwise(0)).alias("preapp_pass"),
    )
    app = rows.select(label("apply_month"), *rest, cells.final_approval().alias("ok")).groupBy(
        *cells.FUNNEL_KEYS
    ).agg(F.count("*").alias("apply_cnt"), sum_or_missing(F.col("ok")).alias("apply_pass"))
    effective = F.col("eff_date").isNotNull() & (F.col("app_status") != words.CANCELLED)
    eff = contracts.withColumn("month", F.col("eff_month").cast("string")).groupBy(*cells.FUNNEL_KEYS).agg(
        F.sum(F.when(effective, 1).otherwise(0)).alias("eff_cnt"),
        sum_or_zero(F.when(effective, F.col("fin_amt")).otherwise(0.0)).alias("eff_amt"),
    )
    return null_safe_join(
        null_safe_join(pre, app, cells.FUNNEL_KEYS, "full"), eff, cells.FUNNEL_KEYS, "full"
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stacked_cells_equal_full_joins(spark, seed):
    preapps, contracts = random_tables(spark, seed)
    names = [*cells.FUNNEL_KEYS, *MEASURES]
    assert dicts(funnel(preapps, contracts), *names) == dicts(funnel_by_joins(preapps, contracts), *names)


@pytest.mark.parametrize("month", ["202503", "202502"])
def test_month_and_brand_filters_equal_filtering_afterwards(spark, month):
    preapps, contracts = random_tables(spark, 4)
    after = funnel(preapps, contracts).filter((F.col("brand") == "A") & (F.col("month") == month))
    before = funnel(preapps, contracts, "A", month)
    assert dicts(before) == dicts(after)
    assert before.count() > 0


def test_single_kinds_are_columns_of_the_funnel(spark):
    preapps, contracts = random_tables(spark, 5)
    whole = funnel(preapps, contracts)
    for part, first in (
        (cells.preapp_cells(preapps, contracts), "preapp_cnt"),
        (cells.apply_cells(preapps, contracts), "apply_cnt"),
        (cells.effective_cells(contracts), "eff_cnt"),
    ):
        assert dicts(part) == dicts(whole.filter(F.col(first).isNotNull()).select(*part.columns))


def test_repeated_contracts_repeat_the_preapproval(spark):
    contracts = frame(
        spark, "contract",
        {"app_id": 1, "prod_class": "p"}, {"app_id": 1, "prod_class": "p"}, {"app_id": 1, "prod_class": "q"},
        {"app_id": 1, "app_status": words.CANCELLED}, {"app_id": 1, "app_status": None},
    )
    preapps = frame(spark, "preapp", {"app_id": 1}, {"app_id": 9})
    got = dicts(cells.preapp_cells(preapps, contracts), "prod_class", "preapp_cnt")
    assert got == [
        {"prod_class": None, "preapp_cnt": 1}, {"prod_class": "p", "preapp_cnt": 2},
        {"prod_class": "q", "preapp_cnt": 1},
    ]
    rows = cells.enrich_preapprovals(preapps, contracts)
    assert dicts(rows, "app_id", "prod_class", "copies") == [
        {"app_id": 1, "prod_class": "p", "copies": 2}, {"app_id": 1, "prod_class": "q", "copies": 1},
        {"app_id": 9, "prod_class": None, "copies": 1},
    ]


def test_rows_of_a_shared_id_follow_the_input(spark):
    for key in (None, 7):
        contracts = frame(spark, "contract", *[{"app_id": key, "prod_class": "p"}] * 20)
        preapps = frame(spark, "preapp", *[{"app_id": key}] * 30)
        for rows in (cells.enrich_preapprovals(preapps, contracts), cells.weigh_preapprovals(preapps, contracts, shares=3)):
            assert [r.copies for r in rows.collect()] == [20] * 30


def test_missing_application_ids_match_each_other(spark):
    contracts = frame(spark, "contract", {"app_id": None, "prod_class": "p"})
    preapps = frame(spark, "preapp", {"app_id": None})
    assert dicts(cells.preapp_cells(preapps, contracts), "prod_class") == [{"prod_class": "p"}]


def test_preapprovals_without_id_are_spread_and_matched(spark):
    contracts = frame(
        spark, "contract", {"app_id": None, "prod_class": "p"}, {"app_id": None, "prod_class": "p"},
        {"app_id": None, "prod_class": "q"}, {"app_id": 1, "prod_class": "r"},
    )
    preapps = frame(spark, "preapp", *[{"app_id": None, "product": str(i)} for i in range(200)], {"app_id": 1})
    got = cells.weigh_preapprovals(preapps, contracts).groupBy("prod_class").agg(
        F.count("*").alias("n"), F.sum("copies").alias("copies")
    )
    assert dicts(got) == [
        {"prod_class": "p", "n": 200, "copies": 400}, {"prod_class": "q", "n": 200, "copies": 200},
        {"prod_class": "r", "n": 1, "copies": 1},
    ]


@pytest.mark.parametrize("manual,auto,manual_result,auto_result,expected", [
    ("2025-01-02", "2025-01-01", words.PASS, "no", 1),
    ("2025-01-02", "2025-01-01", None, words.PASS, 0),
    ("2025-01-01", "2025-01-02", words.PASS, "no", 0),
    ("2025-01-01", "2025-01-01", "no", words.PASS, 1),
    ("", "2025-01-01", "no", words.PASS, 1),
    ("2025-01-01", "", words.PASS, "no", 1),
    (None, "2025-01-01", words.PASS, words.PASS, None),
    ("2025-01-01", None, words.PASS, words.PASS, None),
])
def test_the_later_decision_counts(spark, manual, auto, manual_result, auto_result, expected):
    row = frame(spark, "preapp", {
        "manual_ts": manual, "auto_ts": auto, "manual_result": manual_result, "auto_result": auto_result,
    })
    assert row.select(cells.final_approval().alias("x")).first().x == expected


def test_one_open_decision_makes_the_cell_missing(spark):
    contracts = frame(spark, "contract", {"app_id": 5})
    preapps = frame(
        spark, "preapp",
        {"auto_result": words.PASS}, {"auto_ts": None, "auto_result": words.PASS},
        {"auto_result": words.PASS, "channel_id": "other"},
    )
    got = dicts(cells.apply_cells(preapps, contracts), "channel_id", "apply_cnt", "apply_pass")
    assert got == [
        {"channel_id": "channel_id", "apply_cnt": 2, "apply_pass": None},
        {"channel_id": "other", "apply_cnt": 1, "apply_pass": 1},
    ]


def test_reconsidered_preapprovals_do_not_count_as_passes(spark):
    preapps = frame(
        spark, "preapp", {"preapp_reconsidered": words.YES},
        {"preapp_reconsidered": words.YES, "preapp_result": words.AUTO_PASS},
    )
    got = dicts(cells.preapp_cells(preapps, frame(spark, "contract", {"app_id": 5})), "preapp_cnt", "preapp_pass")
    assert got == [{"preapp_cnt": 2, "preapp_pass": 1}]


def test_contracts_without_date_or_cancelled_make_zero_cells(spark):
    contracts = frame(
        spark, "contract", {"eff_date": None, "fin_amt": 2.0}, {"app_status": words.CANCELLED, "fin_amt": 2.0},
        {"app_status": None, "fin_amt": 3.0, "channel_id": "n"}, {"fin_amt": None, "channel_id": "x"},
    )
    got = dicts(cells.effective_cells(contracts), "month", "channel_id", "eff_cnt", "eff_amt")
    assert got == [
        {"month": "202503", "channel_id": "channel_id", "eff_cnt": 0, "eff_amt": 0.0},
        {"month": "202503", "channel_id": "n", "eff_cnt": 0, "eff_amt": 0.0},
        {"month": "202503", "channel_id": "x", "eff_cnt": 1, "eff_amt": 0.0},
        {"month": None, "channel_id": "channel_id", "eff_cnt": 0, "eff_amt": 0.0},
    ]


def test_top_cells_start_with_preapprovals(spark):
    preapps = frame(
        spark, "preapp", {"app_id": 8, "preapp_date": None, "apply_date": date(2024, 1, 1)},
        {"app_id": 8, "preapp_date": date(2025, 5, 1), "apply_date": None},
    )
    contracts = frame(spark, "contract", {"app_id": 7, "eff_date": date(2023, 1, 1)})
    got = [r.month for r in funnel_top(funnel(preapps, contracts), 4).collect()]
    assert got == ["202505", None, "202401", "202301"]


def test_keys_are_all_used(spark):
    assert set(KEYS) | {"month", "prod_class"} == set(cells.FUNNEL_KEYS)


ODD = [None, "", "\x01", "\x02", "\x020", "\x021", "\x022", "\x02\x01", "a\x01b", "\x0221", "中", " "]


def test_packed_keys_stay_what_they_are(spark):
    """Any text, the marks of the packing too, missing and empty keys: each a cell of its own, with its keys unchanged."""
    pairs = [(a, b) for a in ODD for b in ODD]
    preapps = frame(spark, "preapp", *[{"store_city": a, "product": b} for a, b in pairs])
    contracts = frame(spark, "contract", *[{"app_id": 5, "store_city": a, "product": b, "prod_class": a} for a, b in pairs])
    found = lambda cells_, *keys: sorted([tuple(r[k] for k in keys) for r in cells_.collect()], key=str)
    for got in (cells.preapp_cells(preapps, contracts), cells.apply_cells(preapps, contracts)):
        assert found(got, "store_city", "product") == sorted(pairs, key=str)
    got = funnel(preapps, contracts).filter(F.col("eff_cnt") == 1)
    assert found(got, "prod_class", "store_city", "product") == sorted([(a, a, b) for a, b in pairs], key=str)
    assert got.columns == [*cells.FUNNEL_KEYS, *MEASURES]


def test_cells_are_shuffled_by_one_text_of_keys(spark):
    """Neither the lookup join nor the grouping sends the descriptive keys as columns of their own."""
    plan = cells.apply_cells(frame(spark, "preapp", {}), frame(spark, "contract", {}))._jdf.queryExecution().optimizedPlan()
    joined = plan.toString().split("Join LeftOuter")
    assert len(joined) == 2 and "Aggregate [month#" in joined[0] and "store_city#" not in joined[0].split("Aggregate [month#")[1]


def test_a_preapproval_is_sent_once_for_both_months(spark):
    """Rows are stacked once per pre-approval and contract; they get their months after the shuffle by keys."""
    preapps = frame(spark, "preapp", {"app_id": 1}, {"app_id": 2}, {"app_id": None, "apply_date": None})
    contracts = frame(spark, "contract", {"app_id": 1}, {"app_id": 1})
    assert cells.stack_kinds(preapps, contracts).count() == 5
    plan = funnel(preapps, contracts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("RepartitionByExpression [row_keys#") < plan.index("Join LeftOuter")


@pytest.mark.parametrize("first", [date(1, 1, 1), date(2025, 3, 1), date(9999, 12, 31), None])
@pytest.mark.parametrize("second", [date(1, 1, 1), date(2025, 3, 1), date(9999, 12, 31), None])
def test_both_months_come_out_as_they_were(spark, first, second):
    label = lambda day: None if day is None else str(day.year * 100 + day.month)
    preapps = frame(spark, "preapp", {"app_id": 1, "preapp_date": first, "apply_date": second, "manual_ts": None})
    contracts = frame(spark, "contract", *[{"app_id": 1, "eff_date": second, "product": "other"}] * 3)
    expected = {(label(first), "product"): [3, 0, None, None, None, None]}
    expected.setdefault((label(second), "product"), [None] * 6)[2] = 3
    expected[(label(second), "other")] = [None] * 4 + ([0, 0.0] if second is None else [3, 3.0])
    got = {(r["month"], r["product"]): [r[m] for m in MEASURES] for r in funnel(preapps, contracts).collect()}
    assert got == expected
