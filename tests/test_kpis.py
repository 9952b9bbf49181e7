"""KPIs and the scorecard on hand rows."""

import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from dealerflow import ReportParams
from dealerflow.functions import vocabulary as words
from dealerflow.operators.ranking import points_for, rank_of
from dealerflow.plans import brand, kpis
from dealerflow.plans.scorecard import (
    DETAIL_COLUMNS, overdue_detail, overdue_top, scorecard, scorecard_top,
)
from frames import dicts, frame

P = ReportParams(as_of=date(2025, 3, 15), branch="branch")
FEB, MAR = date(2025, 2, 10), date(2025, 3, 10)
FAST = {"instant_type": words.FIXED_RATIO}


def test_parameters_follow_the_run_date():
    assert (P.month, P.prev_month, P.total_month) == ("202503", "202502", "202502")
    assert (P.active_year, P.fast_track_from) == (2024, date(2024, 1, 1))


@pytest.mark.parametrize("day,minus30,calendar", [
    (1, "202501", "202502"), (15, "202502", "202502"), (31, "202503", "202502"),
])
def test_previous_month(day, minus30, calendar):
    p = ReportParams(as_of=date(2025, 3, day))
    assert p.prev_month == minus30
    assert replace(p, prev="add_months").prev_month == calendar


def test_unknown_modes_are_refused():
    with pytest.raises(ValueError):
        ReportParams(as_of=date(2025, 3, 1), rank_scope="all")
    with pytest.raises(ValueError):
        ReportParams(as_of=date(2025, 3, 1), prev="never")


def test_reports_refuse_to_run_without_their_parameter(spark):
    with pytest.raises(ValueError, match="branch"):
        kpis.team_headcount(frame(spark, "roster", {}), replace(P, branch=None))
    tables = [frame(spark, kind, {}) for kind in ("preapp", "contract", "store", "channel")]
    with pytest.raises(ValueError, match="brand"):
        brand.brand_month_report(*tables, P)
    with pytest.raises(ValueError, match="brand"):
        brand.brand_all_months(*tables, P, ["202503"])


def test_ranks_skip_missing_and_break_ties(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 9)], "id int, x int")
    got = rows.select("id", rank_of(F.col("x"), ["id"]).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [2, None, 3, 1]
    got = rows.select("id", rank_of(F.col("x"), ["id"], descending=False).alias("r")).orderBy("id").collect()
    assert [r.r for r in got] == [1, None, 2, 3]


def test_points_by_rank(spark):
    rows = spark.createDataFrame([(1,), (3,), (4,), (5,), (None,)], "r int")
    got = [r.p for r in rows.select(points_for(F.col("r"), words.OVERDUE_POINTS).alias("p")).collect()]
    assert got == [15.0, 5.0, 20.0, 20.0, 20.0]


def test_distinct_channels_count_missing_as_one(spark):
    rows = frame(spark, "contract", *[
        {"eff_date": date(2024, 6, 1), "channel_id": c} for c in ("1", "1", None, None, "2")
    ], {"eff_date": date(2023, 12, 31), "channel_id": "3"}, {"eff_date": None, "channel_id": "4"})
    assert dicts(kpis.active_channels_year(rows, P)) == [
        {"manager_id": 1, "manager": "m", "active_year": 3}
    ]


@pytest.mark.parametrize("now,year,score", [
    (2, 5, 0.0), (9, 20, 9.0), (49, 100, 16.2), (1, 2, 5.4), (1, 0, None),
])
def test_active_store_points(spark, now, year, score):
    rows = [{"channel_id": f"n{i}"} for i in range(now)]
    rows += [{"channel_id": f"y{i}", "eff_date": date(2024, 5, 5)} for i in range(year)]
    got = dicts(kpis.active_store_score(frame(spark, "contract", *rows), P))[0]
    assert got["active_cur"] == now
    assert got["active_score"] == (None if score is None else pytest.approx(score))


def test_excluded_and_unnamed_managers_have_no_active_score(spark):
    rows = frame(spark, "contract", {"manager": "m"}, {"manager": "gone"}, {"manager": None})
    p = replace(P, excluded=("gone",))
    assert [r["manager"] for r in dicts(kpis.active_store_score(rows, p))] == ["m"]
    assert [r["manager"] for r in dicts(kpis.active_store_score(rows, P))] == ["gone", "m"]


def test_new_stores_per_head(spark):
    channels = frame(
        spark, "channel", *[{"supervisor_id": 1, "supervisor": "a"}] * 3, {"supervisor_id": 2, "supervisor": "b"},
        {"supervisor_id": 3, "supervisor": "c"}, {"supervisor_id": 4, "supervisor": "d", "open_date": FEB},
        {"supervisor_id": None, "supervisor": "n", "channel_id": None},
    )
    roster = frame(
        spark, "roster", *[{"superior_id": 1, "superior_name": "a", "staff_name": None}] * 7,
        {"superior_id": 2, "superior_name": "b"}, {"superior_id": 3, "superior_name": "c", "dept_l6": "else"},
        {"superior_id": None, "superior_name": "n"}, {"superior_id": None, "superior_name": "n"},
    )
    got = {r["supervisor"]: r for r in dicts(kpis.new_store_score(channels, roster, P))}
    assert set(got) == {"a", "b", "c", "n"}
    assert (got["a"]["new_per_head_pct"], got["a"]["new_rank"], got["a"]["new_score"]) == (42.9, 3, 6.0)
    assert (got["b"]["new_per_head_pct"], got["b"]["new_rank"], got["b"]["new_score"]) == (100.0, 1, 12.0)
    assert (got["n"]["heads"], got["n"]["new_rank"], got["n"]["new_score"]) == (2, 2, 9.0)
    assert (got["c"]["heads"], got["c"]["new_rank"], got["c"]["new_score"]) == (None, None, 0.0)


@pytest.mark.parametrize("row,blank_counts,expected", [
    (FAST, False, True), ({"flash_choice": "y"}, False, True), ({"sure_pass_type": "s"}, False, True),
    ({}, False, False), ({"sure_pass_type": ""}, False, True), ({"sure_pass_type": ""}, True, False),
    ({"flash_choice": None}, False, False), (FAST | {"flash_choice": None}, False, True),
    (FAST | {"eff_date": date(2023, 12, 31)}, False, False), (FAST | {"eff_date": date(2024, 1, 1)}, False, True),
    (FAST | {"eff_date": None}, False, False), (FAST | {"app_id": None}, False, False),
    (FAST | {"app_id": 0}, False, False), ({"instant_type": None}, False, False),
])
def test_fast_track(spark, row, blank_counts, expected):
    p = replace(P, blank_is_missing=blank_counts)
    got = dicts(kpis.fast_track_count(frame(spark, "contract", row), p), "fast_cnt")
    assert got == ([{"fast_cnt": 1}] if expected else [])


def manager(i):
    return {"manager_id": i, "manager": f"m{i}"}


def test_overdue_points_prefer_low_rates(spark):
    rows = []
    for i, (late, total) in enumerate([(1, 2), (1, 4), (1, 3), (1, 5), (1, 5), (0, 3)], start=1):
        rows += [manager(i) | FAST | {"overdue_days": 1}] * late
        rows += [manager(i) | FAST | {"overdue_days": 0}] * (total - late)
    got = {r["manager_id"]: r for r in dicts(kpis.overdue_score(frame(spark, "contract", *rows), P))}
    assert set(got) == {1, 2, 3, 4, 5}
    assert [got[i]["overdue_rate"] for i in (1, 2, 3)] == [50.0, 25.0, 33.3]
    assert [got[i]["overdue_rank"] for i in (4, 5, 2, 3, 1)] == [1, 2, 3, 4, 5]
    assert [got[i]["overdue_score"] for i in (4, 5, 2, 3, 1)] == [15.0, 10.0, 5.0, 20.0, 20.0]


def lcv_rows(spark):
    lcv = {"is_lcv": words.YES}
    rows = [manager(1) | lcv | {"eff_date": FEB}] * 2 + [manager(1) | lcv] * 3
    rows += [manager(2) | lcv | {"eff_date": FEB}] + [manager(2) | lcv] * 3
    rows += [manager(3) | lcv] + [manager(4) | {"is_lcv": "no"}]
    rows += [manager(5) | lcv | {"vehicle_type": words.USED_VEHICLE}]
    rows += [manager(6) | lcv | {"eff_date": date(2025, 1, 31)}]
    return frame(spark, "contract", *rows)


def test_lcv_rank_within_the_manager_or_globally(spark):
    within = dicts(kpis.lcv_score(lcv_rows(spark), P), "manager_id", "lcv_mom_pct", "lcv_rank", "lcv_score")
    assert [tuple(r.values()) for r in within] == [
        (1, 50.0, 1, 20.0), (2, 200.0, 1, 20.0), (3, None, None, 0.0),
    ]
    across = dicts(kpis.lcv_score(lcv_rows(spark), replace(P, rank_scope="global")), "manager_id", "lcv_rank", "lcv_score")
    assert [tuple(r.values()) for r in across] == [(1, 2, 15.0), (2, 1, 20.0), (3, None, 0.0)]


def test_partner_rank_as_written_and_by_count(spark):
    deal = {"partner": words.PARTNER_PROJECT}
    rows = frame(
        spark, "contract", manager(1) | deal, *[manager(2) | deal] * 2, manager(3) | deal | {"eff_date": FEB},
        manager(4) | deal | {"vehicle_type": words.USED_VEHICLE},
    )
    got = dicts(kpis.partner_score(rows, P))
    assert [(r["manager_id"], r["partner_cur"], r["partner_rank"], r["partner_score"]) for r in got] == [
        (1, 1, 1, 10.0), (2, 2, 1, 10.0),
    ]
    got = dicts(kpis.partner_score(rows, replace(P, rank_scope="global")))
    assert [(r["partner_rank"], r["partner_score"]) for r in got] == [(2, 7.5), (1, 10.0)]


def test_used_car_growth(spark):
    used = {"vehicle_type": words.USED_VEHICLE, "fin_amt": 6.0}
    rows = [manager(1) | used] * 3
    rows += [manager(2) | used | {"eff_date": FEB}] * 2
    rows += [manager(3) | used | {"eff_date": FEB}] * 2 + [manager(3) | used] * 5
    rows += [manager(4) | used | {"fin_amt": 6.01}]
    rows += [{"manager_id": 5, "manager": None} | used, {"manager_id": 6, "manager": "gone"} | used]
    got = dicts(kpis.used_small_score(frame(spark, "contract", *rows), replace(P, excluded=("gone",))))
    assert [(r["manager_id"], r["used_prev"], r["used_cur"], r["used_mom_pct"], r["used_rank"], r["used_score"])
            for r in got] == [
        (1, None, 3, 100.0, 2, 15.0), (2, 2, None, None, None, 0.0), (3, 2, 5, 150.0, 1, 20.0),
    ]


def random_world(spark, seed):
    rng = random.Random(seed)
    days = [date(2025, 3, d) for d in (1, 15, 31)] + [date(2025, 2, d) for d in (1, 28)]
    days += [date(2024, 12, 31), date(2024, 1, 1), date(2023, 12, 31), None]
    contracts = [{
        "manager_id": (m := rng.choice([1, 2, 3, 4, None])), "manager": rng.choice([f"m{m}", "gone", None]),
        "app_id": rng.choice([1, 2, None]), "eff_date": rng.choice(days),
        "channel_id": rng.choice(["1", "2", "3", None]), "fin_amt": rng.choice([5.0, 6.0, 7.0, None]),
        "vehicle_type": rng.choice([words.NEW_VEHICLE, words.USED_VEHICLE, None]),
        "is_lcv": rng.choice([words.YES, "x"]), "partner": rng.choice([words.PARTNER_PROJECT, "x"]),
        "instant_type": rng.choice([words.FIXED_RATIO, "", None]), "flash_choice": rng.choice(["", "y"]),
        "overdue_days": rng.choice([0, 1, None]),
    } for _ in range(400)]
    channels = [{"supervisor_id": i, "supervisor": f"m{i}", "open_date": rng.choice(days)} for i in (1, 1, 2, 2, 3, 9)]
    roster = [{"superior_id": i, "superior_name": f"m{i}"} for i in (1, 2, 2, 3)]
    return (frame(spark, "contract", *contracts), frame(spark, "channel", *channels), frame(spark, "roster", *roster))


@pytest.mark.parametrize("seed,scope", [(1, "manager"), (2, "global"), (3, "global")])
def test_scorecard_equals_its_kpi_tables(spark, seed, scope):
    contracts, channels, roster = random_world(spark, seed)
    p = replace(P, rank_scope=scope, excluded=("gone",))
    card = {(r["manager_id"], r["manager"]): r for r in dicts(scorecard(contracts, channels, roster, p))}
    tables = [
        dicts(kpis.active_store_score(contracts, p)), dicts(kpis.overdue_score(contracts, p)),
        dicts(kpis.lcv_score(contracts, p)), dicts(kpis.partner_score(contracts, p)),
        dicts(kpis.used_small_score(contracts, p)),
        dicts(kpis.new_store_score(channels, roster, p).withColumnsRenamed(
            {"supervisor_id": "manager_id", "supervisor": "manager"})),
    ]
    expected = {(r["manager_id"], r["manager"]): {} for r in tables[0]}
    for table in tables:
        by_manager = {(r["manager_id"], r["manager"]): r for r in table}
        for who, row in expected.items():
            found = by_manager.get(who, dict.fromkeys(table[0], None))
            row |= {k: v or 0 for k, v in found.items() if k not in ("manager_id", "manager")}
    assert len(expected) >= 4
    assert card.keys() == expected.keys()
    for who, row in expected.items():
        total = (row["active_score"] + row["new_score"]) * 0.3 + row["overdue_score"] + row["lcv_score"]
        row["total_score"] = total + row["partner_score"] + row["used_score"]
        assert {k: v for k, v in card[who].items() if k not in ("manager_id", "manager")} == row


def test_scorecard_fills_figures_but_not_keys(spark):
    contracts = frame(spark, "contract", {"manager_id": None, "manager": "m"})
    card = scorecard(contracts, frame(spark, "channel", {"supervisor": "x"}), frame(spark, "roster", {}), P)
    row = card.first().asDict()
    assert row["manager_id"] is None
    assert row["overdue_score"] == 0.0 and row["new_rank"] == 0 and row["active_year"] == 0
    assert not [k for k, v in row.items() if v is None and k != "manager_id"]


def test_scorecard_top_goes_by_manager(spark):
    contracts = frame(spark, "contract", *[manager(i) for i in (5, 3, 1, 4, 2)], {"manager_id": None})
    card = scorecard(contracts, frame(spark, "channel", {}), frame(spark, "roster", {}), P)
    assert [r.manager_id for r in scorecard_top(card, 4).collect()] == [1, 2, 3, 4]


def test_overdue_detail_columns_and_personal_data(spark):
    rows = frame(spark, "contract", FAST | {"overdue_days": 3}, FAST | {"overdue_days": 0}, {"overdue_days": 3})
    kept = dicts(overdue_detail(rows, P))
    assert len(kept) == 1 and list(kept[0]) == DETAIL_COLUMNS
    assert (kept[0]["app_id"], kept[0]["apply_date"], kept[0]["customer_name"]) == ("1", "2025-03-01", "c")
    assert "customer_name" not in overdue_detail(rows, P, "drop").columns
    assert len(dicts(overdue_detail(rows, P, "hash"))[0]["customer_name"]) == 64
    with pytest.raises(ValueError):
        overdue_detail(rows, P, "show")


def test_latest_overdue_contracts_first(spark):
    late = FAST | {"overdue_days": 9}
    rows = frame(
        spark, "contract", late | {"app_id": 10, "eff_date": FEB}, late | {"app_id": 9, "eff_date": MAR},
        late | {"app_id": 100, "eff_date": MAR}, late | {"app_id": 1, "eff_date": date(2024, 2, 2)},
    )
    assert [r.app_id for r in overdue_top(rows, P, 3).collect()] == ["9", "100", "10"]
