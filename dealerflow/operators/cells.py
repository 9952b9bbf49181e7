"""Funnel cells: measures per month and twelve descriptive keys.

Three kinds of row feed a cell: a pre-approval in its pre-approval month, the
same pre-approval in its application month, and a contract in its effective
month. Each kind is projected to the keys plus all measure columns, with null
in the measures of the other kinds. Stacked and grouped once, that equals full
outer joins of three tables that are unique on the keys: grouping puts missing
keys together, and a measure stays null where its kind has no row.

Until they are cells, rows have their descriptive keys packed into one text and
their months, counts and facts in two numbers: that is what is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerflow.functions import vocabulary as words
from dealerflow.functions.dates import in_month, month_label
from dealerflow.functions.numbers import sum_or_zero
from dealerflow.operators.joins import null_safe_join

FUNNEL_KEYS = [
    "month", "store_city", "prod_category", "prod_class", "product", "partner",
    "vehicle_type", "brand", "manager", "advisor", "channel_l2", "channel_id",
    "store_entity",
]
_ROW_KEYS = FUNNEL_KEYS[1:]
_PREAPP_KEYS = [key for key in _ROW_KEYS if key != "prod_class"]
_PREAPP_FACTS = ["apply_month", "preapp_result", "manual_ts", "auto_ts", "manual_result", "auto_result"]
# One text of the row keys. What goes together is side by side, so that shuffled rows compress; the
# product class, which a pre-approval has from its contract, follows its category.
PACKED = "row_keys"
_PACKED_KEYS = [
    "store_city", "manager", "channel_l2", "vehicle_type", "advisor", "channel_id", "store_entity", "partner",
    "product", "brand", "prod_category",
]
# Between keys, before a code, and what stands for a missing key.
_END, _CODE = "\x01", "\x02"
_MISSING = _CODE + "0"
# Shares of the pre-approvals without an application id, at least.
SPREAD = 64
# Hot applications that are listed, at most.
MOST_HOT = 10_000

PREAPP, APPLY, EFFECTIVE = "preapp", "apply", "effective"


def _coded(key: str) -> Column:
    marked = F.replace(F.replace(F.col(key), F.lit(_CODE), F.lit(_CODE + "2")), F.lit(_END), F.lit(_CODE + "1"))
    return F.coalesce(marked, F.lit(_MISSING))


def _decoded(part: Column) -> Column:
    plain = F.replace(F.replace(part, F.lit(_CODE + "1"), F.lit(_END)), F.lit(_CODE + "2"), F.lit(_CODE))
    return F.when(~part.contains(_CODE), part).when(part != _MISSING, plain)


def with_packed_keys(rows: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """The row keys but the product class as one text, so that shuffled rows are short; keys in ``own`` stay columns too."""
    return rows.withColumn(PACKED, F.concat_ws(_END, *[_coded(key) for key in _PACKED_KEYS if key not in own]))


def with_class() -> Column:
    """Packed keys with the product class, which a pre-approval has from its contract."""
    return F.concat_ws(_END, PACKED, _coded("prod_class")).alias(PACKED)


def unpacked(cells: DataFrame) -> DataFrame:
    """Cells with all their keys as columns."""
    # One text is split once and its parts are picked in a step of their own.
    split = cells.withColumn(PACKED, F.split(PACKED, _END, -1))
    parts = [*[key for key in _PACKED_KEYS if key not in cells.columns], "prod_class"]
    keys = {key: _decoded(F.col(PACKED)[i]).alias(key) for i, key in enumerate(parts)}
    keys["month"] = month_label(F.col("month")).alias("month")
    # Keys of their own keep no alias: plans that read the cells twice are then alike and share their shuffles.
    return split.select(
        *[keys.get(key, key) for key in FUNNEL_KEYS], *[c for c in cells.columns if c not in (*FUNNEL_KEYS, PACKED)]
    )


def _cell(rows: DataFrame) -> list[str]:
    """Columns that tell the cells of packed rows apart, but for the month."""
    return [name for name in ("brand", PACKED) if name in rows.columns]


def contract_lookup(contracts: DataFrame) -> DataFrame:
    """What a pre-approval takes from its contract; cancelled ones are left out."""
    return contracts.filter(F.col("app_status") != words.CANCELLED).select(
        "app_id", "eff_date", "app_status", "prod_class"
    )


def shares_of(preapps: DataFrame) -> int:
    """Shares of the pre-approvals without an application id: at least one per shuffle partition."""
    conf = preapps.sparkSession.conf
    number = conf.get("spark.sql.shuffle.partitions")
    return max(SPREAD, int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", number)))


Hot = Sequence[tuple[object, int]]


def hot_applications(preapps: DataFrame, rows: int) -> Hot:
    """Application ids with more pre-approvals than ``rows``, and in how many shares of that size to spread each.

    One pass over the ids, counted on the map side. ``MOST_HOT`` ids at most: with
    more of them ``rows`` doubles until the list is short enough.
    """
    counted = preapps.filter(F.col("app_id").isNotNull()).groupBy("app_id").agg(F.count(F.lit(1)).alias("rows"))
    found = counted.filter(F.col("rows") > rows).orderBy(F.desc("rows"), "app_id").limit(MOST_HOT + 1).collect()
    while len(found) > MOST_HOT:
        rows *= 2
        found = [r for r in found if r["rows"] > rows]
    return [(r["app_id"], -(-r["rows"] // rows)) for r in found]


def _shares(preapps: DataFrame, rows: DataFrame, shares: int, hot: Hot) -> DataFrame:
    """``rows`` with the number of shares that their application id is spread over."""
    spread = F.when(F.col("app_id").isNull(), shares)
    if not hot:
        return rows.withColumn("shares", spread.otherwise(1))
    kind = preapps.schema["app_id"].dataType.simpleString()
    listed = F.broadcast(preapps.sparkSession.createDataFrame(hot, f"app_id {kind}, hot_shares int"))  # MOST_HOT rows
    joined = rows.join(listed, "app_id", "left")
    return joined.withColumn("shares", spread.otherwise(F.coalesce("hot_shares", F.lit(1)))).drop("hot_shares")


def _counted_join(
    preapps: DataFrame, contracts: DataFrame, columns: list[str], shares: int | None, hot: Hot = ()
) -> DataFrame:
    """Pre-approvals with the distinct ``columns`` of their contracts and how often each occurs.

    Counting the contracts of an application before the join keeps an application
    id with many contracts from multiplying rows.

    Pre-approvals that never got an application id share one key. They are
    spread over ``shares`` by their other columns, and what the contracts without
    an id have is repeated for each share. So are the ids in ``hot`` (from
    ``hot_applications``), over as many shares as their rows need; any other
    hot id is left to the adaptive skew split, which a left join allows on this
    side.
    """
    shares = shares or shares_of(preapps)
    told_apart = ["preapp_date", PACKED, *_PREAPP_KEYS, *([*_PREAPP_FACTS, FACTS, MONTHS] if hot else [])]
    told_apart = [name for name in told_apart if name in preapps.columns]
    share = F.pmod(F.xxhash64(*told_apart), F.col("shares")).cast("int")
    counted = contract_lookup(contracts).groupBy("app_id", *columns).agg(F.count(F.lit(1)).alias("copies"))
    counted = _shares(preapps, counted, shares, hot).withColumn(
        "share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    ).drop("shares")
    spread = _shares(preapps, preapps, shares, hot).withColumn(
        "share", F.when(F.col("shares") > 1, share).otherwise(0)
    ).drop("shares")
    joined = null_safe_join(spread, counted, ["app_id", "share"]).drop("share")
    return joined.withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))


def of_applications(contracts: DataFrame, preapps: DataFrame) -> DataFrame:
    """The contracts that some pre-approval belongs to, a missing id to a missing id.

    For a short list of pre-approvals: their distinct ids are broadcast if the
    planner finds them small, and else the contracts are reduced in one shuffle.
    """
    return null_safe_join(contracts, preapps.select("app_id").distinct(), ["app_id"], "left_semi")


def enrich_preapprovals(
    preapps: DataFrame, contracts: DataFrame, shares: int | None = None, hot: Hot = ()
) -> DataFrame:
    """Pre-approvals with their contract columns; equal contracts are one row with ``copies``."""
    return _counted_join(preapps, contracts, ["eff_date", "app_status", "prod_class"], shares, hot)


def weigh_preapprovals(
    preapps: DataFrame, contracts: DataFrame, shares: int | None = None, hot: Hot = ()
) -> DataFrame:
    """Pre-approvals by product class, with ``copies`` in place of repeated rows.

    The join sees each (id, class) once and the counts are multiplied later.
    """
    return _counted_join(preapps, contracts, ["prod_class"], shares, hot)


def _passed(result: str) -> Column:
    return F.when(F.col(result) == words.PASS, 1).otherwise(0)


def final_approval() -> Column:
    """1 if the later of the two decisions passed, 0 if not, null if unknown.

    The manual decision counts when its time is later as text; a missing time
    leaves the question open.
    """
    manual_later = F.col("manual_ts") > F.col("auto_ts")
    return F.when(manual_later, _passed("manual_result")).when(
        ~manual_later, _passed("auto_result")
    )


def _auto_pass() -> Column:
    return F.when(F.col("preapp_result") == words.AUTO_PASS, 1).otherwise(0)


_MEASURES = {
    PREAPP: ["preapp_cnt", "preapp_pass"],
    APPLY: ["apply_cnt", "apply_ok", "apply_open"],
    EFFECTIVE: ["eff_cnt", "eff_amt"],
}
# Of a row of ``preapproval_rows`` or ``contract_rows``: both months, the number with what is counted, the amount.
MONTHS, FACTS, NUMBER = "months", "facts", "number"
_NO_MONTH = -(2**31)
# Facts of a contract; those of a pre-approval are below.
_CONTRACT = 7


def _month_pair(first: Column, second: Column) -> Column:
    """Two month numbers in one, as shuffled rows of few columns are short."""
    high, low = [F.coalesce(m, F.lit(_NO_MONTH)).cast("bigint") for m in (first, second)]
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _month_of(kind: str) -> Column:
    low = F.shiftleft(MONTHS, 32) if kind == APPLY else F.col(MONTHS)
    return F.nullif(F.shiftright(low, 32).cast("int"), F.lit(_NO_MONTH))


def _facts(kinds: Sequence[str]) -> Column:
    """What the kinds need of a pre-approval as one number: 1 for an automatic pass, and 2 for a decision, 4 if passed."""
    decided = F.coalesce((final_approval() + 1) * 2, F.lit(0))
    return reduce(add, [{PREAPP: _auto_pass(), APPLY: decided}[kind] for kind in kinds])


def _measures(kind: str) -> list[Column]:
    """Measures that a row adds to the cells of a kind, as ``_MEASURES`` names them."""
    number, facts = F.shiftright(NUMBER, 3), F.col(NUMBER).bitwiseAND(7)
    values = {
        PREAPP: lambda: [number, number * facts.bitwiseAND(1)],
        APPLY: lambda: [
            number, number * F.when(facts >= 2, F.shiftright(facts, 1) - 1), number * F.when(facts < 2, 1).otherwise(0)
        ],
        EFFECTIVE: lambda: [number, F.col("eff_amt")],
    }[kind]()
    return [value.alias(name) for name, value in zip(_MEASURES[kind], values, strict=True)]


def _own(month: str | None) -> list[str]:
    """Reports of a month read the brand of their cells and filter on it."""
    return [] if month is None else ["brand"]


def preapproval_rows(
    preapps: DataFrame,
    contracts: DataFrame,
    kinds: tuple[str, ...] = (PREAPP, APPLY),
    month: str | None = None,
    hot: Hot = (),
) -> DataFrame:
    """One row per pre-approval and product class for all kinds, with packed keys, months as numbers and short facts.

    All kinds come out of one scan and one join. For one month, only pre-approvals
    with a date in it are read, and of the contracts only theirs are counted and
    joined.
    """
    if month is not None:
        preapps = preapps.filter(reduce(or_, [
            in_month(F.col(f"{k}_month"), F.col(f"{k}_date"), month) for k in kinds
        ]))
        contracts = of_applications(contracts, preapps)
    own = _own(month)
    # What the kinds need is worked out before the join, so that little is shuffled for it.
    short = with_packed_keys(preapps, own).select(
        "app_id", "preapp_date", *own, PACKED, _facts(kinds).alias(FACTS),
        _month_pair(*[F.col(f"{k}_month") if k in kinds else F.lit(None) for k in (PREAPP, APPLY)]).alias(MONTHS),
    )
    return weigh_preapprovals(short, contracts, hot=hot).select(
        *own, with_class(), MONTHS, (F.col("copies") * 8 + F.col(FACTS)).alias(NUMBER)
    )


def _effective_fields() -> list[Column]:
    effective = F.col("eff_date").isNotNull() & (F.col("app_status") != words.CANCELLED)
    return [
        F.when(effective, 1).otherwise(0).cast("bigint").alias("eff_cnt"),
        F.coalesce(F.when(effective, F.col("fin_amt")).otherwise(0.0), F.lit(0.0)).alias("eff_amt"),
    ]


def effective_rows(contracts: DataFrame) -> DataFrame:
    """Cell rows of the contracts; one without an effective date counts as zero."""
    return contracts.select(month_label(F.col("eff_month")).alias("month"), *_ROW_KEYS, *_effective_fields())


def contract_rows(contracts: DataFrame, month: str | None = None) -> DataFrame:
    """One row per contract in the form of ``preapproval_rows``, without facts."""
    if month is not None:
        contracts = contracts.filter(in_month(F.col("eff_month"), F.col("eff_date"), month))
    own, (number, amount) = _own(month), _effective_fields()
    months = _month_pair(F.col("eff_month"), F.lit(None)).alias(MONTHS)
    return with_packed_keys(contracts, own).select(
        *own, with_class(), months, (number * 8 + _CONTRACT).alias(NUMBER), amount
    )


def _rows_of(kind: str, rows: DataFrame) -> DataFrame:
    """A row of a kind per row, under its month."""
    return rows.select(*_cell(rows), _month_of(kind).alias("month"), *_measures(kind))


def month_rows(rows: DataFrame) -> DataFrame:
    """Stacked rows as a row per kind: two of a pre-approval, one of a contract."""
    kinds = {"month": "int"} | {n: "double" if n == "eff_amt" else "bigint" for names in _MEASURES.values() for n in names}

    def entry(kind: str) -> Column:
        given = dict(zip(_MEASURES[kind], _measures(kind), strict=True)) | {"month": _month_of(kind)}
        return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])

    contract = F.col(NUMBER).bitwiseAND(7) == _CONTRACT
    entries = F.when(contract, F.array(entry(EFFECTIVE))).otherwise(F.array(entry(PREAPP), entry(APPLY)))
    return rows.select(*_cell(rows), F.inline(entries))


def _approved() -> Column:
    """Passes of a cell; missing as soon as one of its decisions is open."""
    return F.when(F.sum("apply_open") == 0, F.sum("apply_ok")).alias("apply_pass")


def preapp_cells(preapps: DataFrame, contracts: DataFrame) -> DataFrame:
    """Pre-approvals and automatic passes per cell."""
    rows = _rows_of(PREAPP, preapproval_rows(preapps, contracts, (PREAPP,)))
    return unpacked(rows.groupBy("month", *_cell(rows)).agg(
        F.sum("preapp_cnt").alias("preapp_cnt"), F.sum("preapp_pass").alias("preapp_pass")
    ))


def apply_cells(preapps: DataFrame, contracts: DataFrame) -> DataFrame:
    """Applications and final passes per cell."""
    rows = _rows_of(APPLY, preapproval_rows(preapps, contracts, (APPLY,)))
    return unpacked(rows.groupBy("month", *_cell(rows)).agg(
        F.sum("apply_cnt").alias("apply_cnt"), _approved()
    ))


def effective_cells(contracts: DataFrame) -> DataFrame:
    """Effective contracts and their amount per cell."""
    return effective_rows(contracts).groupBy(*FUNNEL_KEYS).agg(
        sum_or_zero(F.col("eff_cnt")).alias("eff_cnt"),
        sum_or_zero(F.col("eff_amt")).alias("eff_amt"),
    )


def funnel_cells(rows: DataFrame, month: str | None = None) -> DataFrame:
    """All six measures per cell, from the stacked rows of the three kinds.

    For all months a pre-approval is sent once, by its keys, and gets its row in
    either month where the keys meet. Sums by month would send it twice, as most
    cells have few rows; but all rows of the same twelve keys meet in one task.
    For one month the sums are sent.
    """
    if month is None:
        rows = month_rows(rows.repartition(PACKED))
    else:
        rows = month_rows(rows).filter(F.col("month") == int(month))
    return unpacked(rows.groupBy("month", *_cell(rows)).agg(
        F.sum("preapp_cnt").alias("preapp_cnt"),
        F.sum("preapp_pass").alias("preapp_pass"),
        F.sum("apply_cnt").alias("apply_cnt"),
        _approved(),
        F.sum("eff_cnt").alias("eff_cnt"),
        F.sum("eff_amt").alias("eff_amt"),
    ))


def stack_kinds(
    preapps: DataFrame, contracts: DataFrame, brand: str | None = None, month: str | None = None, hot: Hot = ()
) -> DataFrame:
    """Rows of all three kinds, with the brand and month filters at the scans.

    The contract lookup behind the pre-approvals keeps every brand and month, as
    a pre-approval may belong to a contract of another one.
    """
    own_contracts = contracts
    if brand is not None:
        preapps = preapps.filter(F.col("brand") == brand)
        own_contracts = contracts.filter(F.col("brand") == brand)
    return preapproval_rows(preapps, contracts, month=month, hot=hot).unionByName(
        contract_rows(own_contracts, month), allowMissingColumns=True
    )
