"""The engine's inputs derived from the driver's test tables.

Line items play the pre-approvals and, above a discount, the contracts;
customers play the channels, nations the managers, suppliers the staff, events
the store visits. FIXTURES.md lists the mapping. Tables are joined along their
foreign keys; part joins only where product columns are wanted. No side is
marked for broadcast: the planner decides by size.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerflow.functions import vocabulary as words
from dealerflow.operators import cleaning
from dealerflow.params import ReportParams

PARAMS = ReportParams(
    as_of=date(1996, 3, 15),
    brand="Brand#1",
    branch="BRANCH_A",
    partner="1-URGENT",
    excluded=("NATION_3",),
    year=1995,
    cutoff=date(1995, 1, 1),
)
#: Months of the all-months tables: the test tables' years, and cells without a month.
MONTHS = [*(f"{year}{month:02d}" for year in range(1995, 2002) for month in range(1, 13)), None]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BRANDS = 25

PRODUCT = {"brand": "p_brand", "prod_class": "p_type", "prod_category": "p_type", "product": "p_name"}


# Declared, so that opening a table starts no job to read file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _bits(conditions: dict[str, Column]) -> Column:
    """Which conditions hold, as bits of one number; one that is not known does not hold."""
    return reduce(add, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())])


def _base(spark: SparkSession, sf_dir: str, with_part: bool, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Lines with their part and parties, and whether ``conditions`` on the line hold.

    Shuffled rows are kept short: the conditions are worked out before the joins,
    and the shipping time is a day and the time since then.
    With parts, what only one of the extracts reads of an order is one column, so
    that both read the same orders and these are shuffled once.
    """
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    lines = lines.withColumns({
        "l_shipday": _ship_day(),
        "l_shiptime": F.col("l_shipdate") - _ship_day().cast("timestamp_ntz"),
        **({"l_bits": _bits(conditions)} if conditions else {}),
    })
    if with_part:
        facts = F.array("o_orderstatus", F.col("o_orderdate").cast("string"))
        orders = orders.withColumn("o_facts", facts).drop("o_orderstatus", "o_orderdate")
        lines = lines.join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    parties = (
        orders
        .join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    joined = lines.join(parties, F.col("l_orderkey") == F.col("o_orderkey"))
    if with_part:
        joined = joined.withColumns({
            "o_orderstatus": F.col("o_facts")[0], "o_orderdate": F.col("o_facts")[1].cast("timestamp_ntz"),
        })
    return joined.withColumns({name: F.getbit("l_bits", F.lit(i)) == 1 for i, name in enumerate(conditions or ())})


def _numbered(name: str, number: str, pair: str) -> Column:
    """A name with a number in parentheses, for the cleaning step to strip."""
    return F.concat(name, F.lit(pair[0]), F.col(number).cast("string"), F.lit(pair[1]))


def _shared(with_part: bool) -> dict[str, Column]:
    used = F.col("c_mktsegment").isin("AUTOMOBILE", "HOUSEHOLD")
    columns = {
        "channel_id": F.col("c_custkey").cast("string"),
        "manager": _numbered("n_name", "c_nationkey", "()"),
        "advisor": F.when(
            F.col("c_mktsegment") != "BUILDING", _numbered("c_mktsegment", "c_nationkey", "（）")
        ),
        "store_city": F.col("n_name"),
        "partner": F.col("o_orderpriority"),
        "vehicle_type": F.when(used, words.USED_VEHICLE).otherwise(words.NEW_VEHICLE),
        "channel_l2": F.col("c_mktsegment"),
        "store_entity": F.col("c_name"),
    }
    if with_part:
        columns |= {name: F.col(source) for name, source in PRODUCT.items()}
    return columns


def _app_id() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def _ship_day() -> Column:
    return F.to_date("l_shipdate")


def raw_contracts(
    spark: SparkSession, sf_dir: str, with_part: bool = True, as_text: bool = False
) -> DataFrame:
    """Contract extract; dates as text as in a CSV, or typed as in a Parquet table."""
    undated = F.col("l_quantity") == 50
    apply_day = F.col("l_shipday")
    eff_day = F.when(~undated, F.date_add("l_shipday", 15))
    if as_text:
        apply_day = F.date_format(apply_day, "yyyy-MM-dd")
        eff_day = F.coalesce(F.date_format(eff_day, "yyyy/M/d"), F.lit(""))
    return _base(spark, sf_dir, with_part).filter(F.col("l_discount") >= 0.05).select(
        _app_id().alias("app_id"),
        F.col("l_extendedprice").alias("fin_amt"),
        apply_day.alias("apply_date"),
        eff_day.alias("eff_date"),
        F.col("c_nationkey").alias("manager_id"),
        F.when(F.col("o_orderstatus") == "P", words.CANCELLED).otherwise("ACTIVE").alias("app_status"),
        *[column.alias(name) for name, column in _shared(with_part).items()],
        F.when(F.col("l_linestatus") == "F", words.FIXED_RATIO).otherwise("OTHER").alias("instant_type"),
        F.when(F.col("l_returnflag") == "A", "Y").otherwise("").alias("flash_choice"),
        F.when(F.col("l_tax") >= 0.07, "S").alias("sure_pass_type"),
        (F.col("l_quantity").cast("int") - 45).alias("overdue_days"),
        F.when(F.col("l_returnflag") == "R", words.YES).otherwise("否").alias("is_lcv"),
        F.col("l_linestatus").alias("overdue_level"),
        F.col("l_linenumber").alias("paid_terms"),
        (F.col("l_extendedprice") * (1.0 - F.col("l_discount"))).alias("remaining_principal"),
        F.col("c_name").alias("customer_name"),
    )


def raw_preapprovals(
    spark: SparkSession, sf_dir: str, with_part: bool = True, as_text: bool = False
) -> DataFrame:
    """Pre-approval extract over every line item."""
    conditions = {
        "dated": F.col("l_quantity") != 50,
        "numbered": F.col("l_quantity") != 49,
        "open": F.col("l_linestatus") == "O",
        "fulfilled": F.col("l_linestatus") == "F",
        "returned": F.col("l_returnflag") == "R",
        "flagged": F.col("l_returnflag") != "N",
        "taxed": F.col("l_tax") != 0,
        "highly_taxed": F.col("l_tax") > 0.04,
    }
    preapp_day = F.to_date("o_orderdate")
    apply_ts = F.when(F.col("dated"), F.col("l_shipday").cast("timestamp_ntz") + F.col("l_shiptime"))
    if as_text:
        preapp_day = F.concat(F.date_format(preapp_day, "yyyy/MM/dd"), F.lit(" 08:30:00"))
        apply_ts = F.coalesce(F.date_format(apply_ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    time_text = "yyyy-MM-dd HH:mm:ss"

    def later(days: int) -> Column:
        return F.date_format(F.date_add("l_shipday", days), time_text)

    return _base(spark, sf_dir, with_part, conditions).select(
        F.when(F.col("numbered"), _app_id()).alias("app_id"),
        apply_ts.alias("apply_ts"),
        preapp_day.alias("preapp_date"),
        *[column.alias(name) for name, column in _shared(with_part).items() if name != "prod_class"],
        F.when(F.col("open"), words.AUTO_PASS).otherwise("人工").alias("preapp_result"),
        F.when(F.col("returned"), words.YES).otherwise("否").alias("preapp_reconsidered"),
        F.when(F.col("highly_taxed"), later(2)).otherwise("").alias("manual_ts"),
        F.when(F.col("taxed"), later(1)).alias("auto_ts"),
        F.when(F.col("flagged"), words.PASS).otherwise("拒绝").alias("manual_result"),
        F.when(F.col("fulfilled"), words.PASS).otherwise("拒绝").alias("auto_result"),
    )


def raw_channels(spark: SparkSession, sf_dir: str, as_text: bool = False) -> DataFrame:
    """Channel extract: one channel per customer, opened with its first order."""
    opened = (
        _table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.min(F.to_date("o_orderdate")).alias("opened"))
    )
    open_day = F.col("opened")
    close_day = F.when(F.col("c_acctbal") < 0, F.date_add("opened", 400))
    nation_id = F.col("n_nationkey")
    if as_text:
        open_day = F.coalesce(F.date_format(open_day, "yyyyMMdd"), F.lit(""))
        close_day = F.coalesce(F.date_format(close_day, "yyyy-M-d"), F.lit(""))
        nation_id = nation_id.cast("string")
    return (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(opened, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_name").alias("entity_name"),
            F.col("c_custkey").cast("string").alias("channel_id"),
            F.when(F.col("c_acctbal") < 0, "CLOSED").otherwise("OPEN").alias("channel_status"),
            F.concat("c_mktsegment", F.lit("(x)")).alias("owner"),
            _numbered("n_name", "n_nationkey", "()").alias("supervisor"),
            nation_id.alias("supervisor_id"),
            open_day.alias("open_date"),
            close_day.alias("close_date"),
        )
    )


def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit extract, all text: start, end after ``value`` minutes, who and for whom."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    seconds = F.floor(F.col("value") * 60.0).cast("decimal(18,6)")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    who = F.col("user_id").cast("string")
    return _table(spark, sf_dir, "events").select(
        F.date_format("ts", stamp).alias("visit_start"),
        F.date_format(end, stamp).alias("visit_end"),
        F.col("value").cast("string").alias("visit_minutes"),
        F.concat(F.lit("user_"), who, F.lit("("), F.col("event_type"), F.lit(")")).alias("visitor"),
        F.concat("event_type", F.lit("（"), who, F.lit("）")).alias("supervisor"),
    )


def raw_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff extract: suppliers under their nation, two branches."""
    return (
        _table(spark, sf_dir, "supplier")
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.when(F.col("s_acctbal") >= 0, "BRANCH_A").otherwise("BRANCH_B").alias("dept_l6"),
            F.col("n_nationkey").alias("superior_id"),
            F.col("n_name").alias("superior_name"),
            F.col("s_name").alias("staff_name"),
        )
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store list: every customer carries the five brands of its market segment.

    A store with a negative balance is listed under a name no channel has.
    """
    first = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    name = F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("-X"))).otherwise(F.col("c_name"))
    carried = F.sequence(first, F.lit(BRANDS).cast("bigint"), F.lit(len(SEGMENTS)).cast("bigint"))
    return (
        _table(spark, sf_dir, "customer")
        .select(
            F.explode(carried).alias("brand_no"),
            name.alias("store_name"),
            F.format_string("No. %d, %s", "c_custkey", "c_mktsegment").alias("address"),
            F.col("c_custkey").alias("store_no"),
        )
        .select(
            F.concat(F.lit("Brand#"), F.col("brand_no").cast("string")).alias("brand"),
            "store_name",
            "address",
            (F.col("store_no") * 100 + F.col("brand_no")).alias("position"),
        )
    )


def contracts(spark: SparkSession, sf_dir: str, with_part: bool = True) -> DataFrame:
    return cleaning.clean_contracts(raw_contracts(spark, sf_dir, with_part))


def preapprovals(spark: SparkSession, sf_dir: str, with_part: bool = True) -> DataFrame:
    return cleaning.clean_preapprovals(raw_preapprovals(spark, sf_dir, with_part))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_channels(raw_channels(spark, sf_dir))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_visits(raw_visits(spark, sf_dir))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_roster(raw_roster(spark, sf_dir))
