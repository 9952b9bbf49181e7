"""Small typed frames with every column the operators read."""

from __future__ import annotations

from datetime import date

from pyspark.sql.types import (
    DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

from dealerflow.functions import vocabulary as words

KEYS = [
    "store_city", "prod_category", "product", "partner", "vehicle_type", "brand", "manager",
    "advisor", "channel_l2", "channel_id", "store_entity",
]
TEXT = StringType()

CONTRACT = StructType([
    StructField("app_id", LongType()), StructField("fin_amt", DoubleType()),
    StructField("apply_date", DateType()), StructField("eff_date", DateType()),
    StructField("eff_month", IntegerType()), StructField("manager_id", IntegerType()),
    StructField("app_status", TEXT), StructField("prod_class", TEXT),
    *[StructField(k, TEXT) for k in KEYS],
    StructField("instant_type", TEXT), StructField("flash_choice", TEXT),
    StructField("sure_pass_type", TEXT), StructField("overdue_days", IntegerType()),
    StructField("is_lcv", TEXT), StructField("overdue_level", TEXT),
    StructField("paid_terms", IntegerType()), StructField("remaining_principal", DoubleType()),
    StructField("customer_name", TEXT),
])
PREAPP = StructType([
    StructField("app_id", LongType()), StructField("preapp_date", DateType()),
    StructField("preapp_month", IntegerType()), StructField("apply_date", DateType()),
    StructField("apply_month", IntegerType()), *[StructField(k, TEXT) for k in KEYS],
    *[StructField(n, TEXT) for n in (
        "preapp_result", "preapp_reconsidered", "manual_ts", "auto_ts", "manual_result", "auto_result",
    )],
])
CHANNEL = StructType([
    *[StructField(n, TEXT) for n in ("entity_name", "channel_id", "channel_status", "owner", "supervisor")],
    StructField("supervisor_id", IntegerType()), StructField("open_date", DateType()),
    StructField("close_date", DateType()),
])
ROSTER = StructType([
    StructField("dept_l6", TEXT), StructField("superior_id", IntegerType()),
    StructField("superior_name", TEXT), StructField("staff_name", TEXT),
])
STORE = StructType([StructField(n, TEXT) for n in ("brand", "store_name", "address")])

KEY_DEFAULTS = {k: k for k in KEYS} | {"vehicle_type": words.NEW_VEHICLE, "brand": "B", "manager": "m"}
DEFAULTS = {
    "contract": KEY_DEFAULTS | {
        "app_id": 1, "fin_amt": 1.0, "apply_date": date(2025, 3, 1), "eff_date": date(2025, 3, 10),
        "manager_id": 1, "app_status": "ok", "prod_class": "class", "instant_type": "",
        "flash_choice": "", "sure_pass_type": None, "overdue_days": None, "is_lcv": "",
        "overdue_level": "M1", "paid_terms": 3, "remaining_principal": 10.0, "customer_name": "c",
    },
    "preapp": KEY_DEFAULTS | {
        "app_id": 1, "preapp_date": date(2025, 3, 1), "apply_date": date(2025, 3, 2),
        "preapp_result": "", "preapp_reconsidered": "", "manual_ts": "", "auto_ts": "2025-03-02 00:00:00",
        "manual_result": "", "auto_result": "",
    },
    "channel": {
        "entity_name": "store", "channel_id": "channel_id", "channel_status": "open", "owner": "o",
        "supervisor": "m", "supervisor_id": 1, "open_date": date(2025, 3, 5), "close_date": None,
    },
    "roster": {"dept_l6": "branch", "superior_id": 1, "superior_name": "m", "staff_name": "s"},
    "store": {"brand": "B", "store_name": "store", "address": "a"},
}
SCHEMAS = {"contract": CONTRACT, "preapp": PREAPP, "channel": CHANNEL, "roster": ROSTER, "store": STORE}


def _month(day):
    return None if day is None else day.year * 100 + day.month


def frame(spark, kind, *rows):
    """One row per dict of differences from the defaults of that kind."""
    schema = SCHEMAS[kind]
    full = []
    for row in rows:
        unknown = set(row) - set(schema.names)
        assert not unknown, unknown
        values = DEFAULTS[kind] | row
        if kind == "contract":
            values["eff_month"] = _month(values["eff_date"])
        if kind == "preapp":
            values["preapp_month"] = _month(values["preapp_date"])
            values["apply_month"] = _month(values["apply_date"])
        full.append(tuple(values[n] for n in schema.names))
    return spark.createDataFrame(full, schema)


def dicts(df, *keys):
    """Rows as dicts, sorted by their text; only ``keys`` if given."""
    rows = [r.asDict() for r in df.collect()]
    if keys:
        rows = [{k: r[k] for k in keys} for r in rows]
    return sorted(rows, key=lambda r: [str(v) for v in r.values()])
