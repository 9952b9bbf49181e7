"""One SQL statement per registered query.

The statements follow the report definitions step by step (separate tables,
null-safe joins, contracts repeated per match) rather than the Spark plans, so
that agreement says something. Parameters are those of the test tables' reports.
"""

from __future__ import annotations

KEYS = [
    "month", "store_city", "prod_category", "prod_class", "product", "partner", "vehicle_type",
    "brand", "manager", "advisor", "channel_l2", "channel_id", "store_entity",
]
STORE = ["channel_id", "store_name", "address", "owner", "supervisor", "channel_status"]
COUNTS = ["preapp_cnt", "preapp_pass", "apply_cnt", "apply_pass", "eff_cnt"]
NOW, BEFORE, LABEL = "199603", "199602", "199602"
MONTHS = [*(f"{year}{month:02d}" for year in range(1995, 2002) for month in range(1, 13)), "null"]
BRAND, EXCLUDED, PARTNER, BRANCH = "Brand#1", "NATION_3", "1-URGENT", "BRANCH_A"


def cols(names, prefix=""):
    return ", ".join(f"{prefix}{n}" for n in names)


def same(left, right, names):
    return " AND ".join(f"{left}.{n} IS NOT DISTINCT FROM {right}.{n}" for n in names)


def texts(*names):
    return "* REPLACE (" + ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names) + ")"


def stripped(text):
    half = f"regexp_replace({text}, '\\(.*\\)', '', 'gs')"
    return f"regexp_replace({half}, '（.*）', '', 'gs')"


def nearest(x, digits):
    p = f"{10 ** digits}e0"
    low, high = f"floor(({x}) * {p}) / {p}", f"ceil(({x}) * {p}) / {p}"
    return (
        f"(CASE WHEN ({x}) IS NULL THEN NULL"
        f" WHEN ({x}) - {low} < {high} - ({x}) THEN {low}"
        f" WHEN ({x}) - {low} = {high} - ({x}) AND floor(({x}) * {p}) % 2 = 0 THEN {low}"
        f" ELSE {high} + 0e0 END)"
    )


def by_month(value="eff_cnt"):
    """A column for each month of the fixed list."""
    return ", ".join(f"max(CASE WHEN month = '{m}' THEN {value} END) AS \"{m}\"" for m in MONTHS)


def level(count):
    return f"CASE WHEN {count} <= 1 THEN 1 WHEN {count} <= 2 THEN 2 WHEN {count} > 2 THEN 3 END"


def ranked(metric, way, ties, within=""):
    part = f"PARTITION BY {within} " if within else ""
    order = ", ".join([f"{metric} {way} NULLS LAST", *[f"{t} ASC NULLS LAST" for t in ties]])
    return (
        f"CASE WHEN {metric} IS NOT NULL THEN "
        f"CAST(row_number() OVER ({part}ORDER BY {order}) AS INTEGER) END"
    )


def points(rank, first, other):
    whens = " ".join(f"WHEN {rank} = {i} THEN {v}e0" for i, v in enumerate(first, 1))
    return f"CASE {whens} ELSE {other}e0 END"


MANAGER = ["manager_id", "manager"]
USED_SEGMENTS = "('AUTOMOBILE', 'HOUSEHOLD')"

BASE = """
base AS (
  SELECT * FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
)"""

SHARED = f"""
  CAST(c_custkey AS VARCHAR) AS channel_id,
  {stripped("n_name || '(' || c_nationkey || ')'")} AS manager,
  {stripped("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || '（' || c_nationkey || '）' END")} AS advisor,
  n_name AS store_city, o_orderpriority AS partner,
  CASE WHEN c_mktsegment IN {USED_SEGMENTS} THEN '二手车' ELSE '新车' END AS vehicle_type,
  c_mktsegment AS channel_l2, c_name AS store_entity,
  p_brand AS brand, p_type AS prod_category, p_name AS product"""

CONTRACTS = f"""
contracts AS (
  SELECT *, CAST(strftime(eff_date, '%Y%m') AS INTEGER) AS eff_month FROM (
    SELECT l_orderkey * 8 + l_linenumber AS app_id,
      l_extendedprice / 10000e0 AS fin_amt,
      CAST(l_shipdate AS DATE) AS apply_date,
      CASE WHEN l_quantity <> 50 THEN CAST(l_shipdate AS DATE) + 15 END AS eff_date,
      c_nationkey AS manager_id,
      CASE WHEN o_orderstatus = 'P' THEN '订单已取消' ELSE 'ACTIVE' END AS app_status,
      {SHARED}, p_type AS prod_class,
      CASE WHEN l_linestatus = 'F' THEN '固定比例' ELSE 'OTHER' END AS instant_type,
      CASE WHEN l_returnflag = 'A' THEN 'Y' ELSE '' END AS flash_choice,
      CASE WHEN l_tax >= 0.07 THEN 'S' END AS sure_pass_type,
      CAST(l_quantity AS INTEGER) - 45 AS overdue_days,
      CASE WHEN l_returnflag = 'R' THEN '是' ELSE '否' END AS is_lcv,
      l_linestatus AS overdue_level, l_linenumber AS paid_terms,
      l_extendedprice * (1e0 - l_discount) AS remaining_principal,
      c_name AS customer_name
    FROM base WHERE l_discount >= 0.05
  )
)"""

PREAPPS = f"""
preapps AS (
  SELECT *, CAST(strftime(preapp_date, '%Y%m') AS INTEGER) AS preapp_month,
    CAST(strftime(apply_date, '%Y%m') AS INTEGER) AS apply_month FROM (
    SELECT CASE WHEN l_quantity <> 49 THEN l_orderkey * 8 + l_linenumber END AS app_id,
      CAST(o_orderdate AS DATE) AS preapp_date,
      CASE WHEN l_quantity <> 50 THEN CAST(l_shipdate AS DATE) END AS apply_date,
      CASE WHEN l_quantity <> 50 THEN strftime(l_shipdate, '%H') END AS apply_hour,
      {SHARED},
      CASE WHEN l_linestatus = 'O' THEN '自动通过' ELSE '人工' END AS preapp_result,
      CASE WHEN l_returnflag = 'R' THEN '是' ELSE '否' END AS preapp_reconsidered,
      CASE WHEN l_tax > 0.04 THEN strftime(CAST(l_shipdate AS DATE) + 2, '%Y-%m-%d 00:00:00') ELSE '' END AS manual_ts,
      CASE WHEN l_tax <> 0 THEN strftime(CAST(l_shipdate AS DATE) + 1, '%Y-%m-%d 00:00:00') END AS auto_ts,
      CASE WHEN l_returnflag <> 'N' THEN '通过' ELSE '拒绝' END AS manual_result,
      CASE WHEN l_linestatus = 'F' THEN '通过' ELSE '拒绝' END AS auto_result
    FROM base
  )
)"""

CHANNELS = f"""
channels AS (
  SELECT c_name AS entity_name, CAST(c_custkey AS VARCHAR) AS channel_id,
    CASE WHEN c_acctbal < 0 THEN 'CLOSED' ELSE 'OPEN' END AS channel_status,
    {stripped("c_mktsegment || '(x)'")} AS owner,
    {stripped("n_name || '(' || n_nationkey || ')'")} AS supervisor,
    n_nationkey AS supervisor_id, opened AS open_date,
    CASE WHEN c_acctbal < 0 THEN opened + 400 END AS close_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS opened FROM orders GROUP BY 1)
    ON c_custkey = o_custkey
)"""

ROSTER = """
roster AS (
  SELECT CASE WHEN s_acctbal >= 0 THEN 'BRANCH_A' ELSE 'BRANCH_B' END AS dept_l6,
    n_nationkey AS superior_id, n_name AS superior_name, s_name AS staff_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""

STORES = """
stores AS (
  SELECT 'Brand#' || brand_no AS brand,
    CASE WHEN c_acctbal < 0 THEN c_name || '-X' ELSE c_name END AS store_name,
    'No. ' || c_custkey || ', ' || c_mktsegment AS address,
    c_custkey * 100 + brand_no AS position
  FROM customer
  JOIN (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 3), ('HOUSEHOLD', 4), ('MACHINERY', 5)) AS s(segment, first)
    ON c_mktsegment = segment
  CROSS JOIN LATERAL (SELECT unnest(range(first, 26, 5)) AS brand_no)
)"""

BRAND_STORES = """
brand_stores AS (
  SELECT brand, store_name, address, channel_id, owner, supervisor, channel_status
  FROM stores LEFT JOIN channels ON store_name IS NOT DISTINCT FROM entity_name
)"""

LOOKUP = """
lookup AS (
  SELECT app_id, eff_date, app_status, prod_class FROM contracts WHERE app_status <> '订单已取消'
)"""

ENRICHED = """
enriched AS (
  SELECT preapps.*, lookup.eff_date, lookup.app_status, lookup.prod_class
  FROM preapps LEFT JOIN lookup ON preapps.app_id IS NOT DISTINCT FROM lookup.app_id
)"""

WEIGHTED = """
weighted AS (
  SELECT preapps.*, prod_class, coalesce(n, 1) AS copies
  FROM preapps
  LEFT JOIN (SELECT app_id AS contract_id, prod_class, count(*) AS n FROM lookup GROUP BY 1, 2)
    ON app_id IS NOT DISTINCT FROM contract_id
)"""

PRE_CELLS = f"""
pre_cells AS (
  SELECT {cols(KEYS)}, count(*) AS preapp_cnt,
    CAST(sum(CASE WHEN preapp_result = '自动通过' THEN 1 ELSE 0 END) AS BIGINT) AS preapp_pass
  FROM (SELECT *, strftime(preapp_date, '%Y%m') AS month FROM enriched) GROUP BY ALL
)"""

APPLY_CELLS = f"""
apply_cells AS (
  SELECT {cols(KEYS)}, count(*) AS apply_cnt,
    CASE WHEN count(*) = count(passed) THEN CAST(sum(passed) AS BIGINT) END AS apply_pass
  FROM (
    SELECT *, strftime(apply_date, '%Y%m') AS month, CASE
      WHEN manual_ts > auto_ts THEN CASE WHEN manual_result = '通过' THEN 1 ELSE 0 END
      WHEN NOT (manual_ts > auto_ts) THEN CASE WHEN auto_result = '通过' THEN 1 ELSE 0 END
    END AS passed FROM enriched
  ) GROUP BY {cols(KEYS)}
)"""

EFF_CELLS = f"""
eff_cells AS (
  SELECT {cols(KEYS)},
    CAST(sum(CASE WHEN eff_date IS NOT NULL AND app_status <> '订单已取消' THEN 1 ELSE 0 END) AS BIGINT) AS eff_cnt,
    coalesce(sum(CASE WHEN eff_date IS NOT NULL AND app_status <> '订单已取消' THEN fin_amt ELSE 0e0 END), 0e0) AS eff_amt
  FROM (SELECT *, strftime(eff_date, '%Y%m') AS month FROM contracts) GROUP BY {cols(KEYS)}
)"""

FUNNEL = f"""
first_two AS (
  SELECT {", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in KEYS)}, preapp_cnt, preapp_pass, apply_cnt, apply_pass
  FROM pre_cells a FULL JOIN apply_cells b ON {same("a", "b", KEYS)}
),
funnel AS (
  SELECT {", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in KEYS)}, preapp_cnt, preapp_pass, apply_cnt, apply_pass, eff_cnt, eff_amt
  FROM first_two a FULL JOIN eff_cells b ON {same("a", "b", KEYS)}
)"""

MONTH_DETAIL = f"""
measures AS (
  SELECT brand, month, channel_id,
    {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTS)},
    coalesce(sum(round_even(eff_amt, 0)), 0e0) AS eff_amt
  FROM funnel WHERE brand = '{BRAND}' AND month = '{NOW}' GROUP BY brand, month, channel_id
),
detail AS (
  SELECT m.brand, m.month, s.channel_id, store_name, address, owner, supervisor, channel_status,
    {cols(COUNTS)}, eff_amt
  FROM measures m RIGHT JOIN brand_stores s ON m.channel_id IS NOT DISTINCT FROM s.channel_id
  WHERE s.brand = '{BRAND}'
),
total AS (
  SELECT brand, '{LABEL}' AS month, '合计' AS channel_id,
    {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTS)},
    coalesce(sum(eff_amt), 0e0) AS eff_amt
  FROM (SELECT brand, month AS real_month, {cols(COUNTS)}, eff_amt FROM detail)
  WHERE brand IS NOT NULL GROUP BY brand, real_month
)"""

ALL_MONTHS = f"""
year_rows AS (
  SELECT brand, month, channel_id, CAST(coalesce(sum(eff_cnt), 0) AS BIGINT) AS eff_cnt
  FROM funnel WHERE brand = '{BRAND}' GROUP BY brand, month, channel_id
),
cells AS (
  SELECT m.brand, {cols(STORE, "s.")}, CASE WHEN m.present THEN coalesce(m.month, 'null') END AS month, eff_cnt
  FROM (SELECT *, true AS present FROM year_rows) m RIGHT JOIN brand_stores s ON m.channel_id IS NOT DISTINCT FROM s.channel_id
  WHERE s.brand = '{BRAND}'
)"""

# Every brand's report at once: the brand of the store list chooses the report.
EVERY_MONTH_DETAIL = f"""
measures AS (
  SELECT brand, month, channel_id,
    {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTS)},
    coalesce(sum(round_even(eff_amt, 0)), 0e0) AS eff_amt
  FROM funnel WHERE month = '{NOW}' GROUP BY brand, month, channel_id
),
detail AS (
  SELECT s.brand AS report_brand, m.brand, m.month, s.channel_id, store_name, address, owner, supervisor,
    channel_status, {cols(COUNTS)}, eff_amt
  FROM brand_stores s LEFT JOIN measures m ON m.brand = s.brand AND m.channel_id IS NOT DISTINCT FROM s.channel_id
),
total AS (
  SELECT report_brand, brand, '{LABEL}' AS month, '合计' AS channel_id,
    {", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in COUNTS)},
    coalesce(sum(eff_amt), 0e0) AS eff_amt
  FROM (SELECT report_brand, brand, month AS real_month, {cols(COUNTS)}, eff_amt FROM detail)
  WHERE brand IS NOT NULL GROUP BY report_brand, brand, real_month
)"""

EVERY_ALL_MONTHS = f"""
year_rows AS (
  SELECT brand, month, channel_id, CAST(coalesce(sum(eff_cnt), 0) AS BIGINT) AS eff_cnt
  FROM funnel GROUP BY brand, month, channel_id
),
cells AS (
  SELECT s.brand AS report_brand, m.brand, {cols(STORE, "s.")}, CASE WHEN m.present THEN coalesce(m.month, 'null') END AS month, eff_cnt
  FROM brand_stores s LEFT JOIN (SELECT *, true AS present FROM year_rows) m
    ON m.brand = s.brand AND m.channel_id IS NOT DISTINCT FROM s.channel_id
)"""

YEAR_ACTIVE = """
year_active AS (
  SELECT manager_id, manager, count(DISTINCT channel_id) + max(CASE WHEN channel_id IS NULL THEN 1 ELSE 0 END) AS active_year
  FROM contracts WHERE strftime(eff_date, '%Y-%m') BETWEEN '1995-01' AND '1995-12' GROUP BY 1, 2
)"""

ACTIVE = f"""
active AS (
  SELECT *, CASE WHEN active_pct >= 50 THEN 18e0 WHEN active_pct <= 40 THEN 0e0 ELSE (active_pct - 40) * 6e0 END * 0.3e0 AS active_score
  FROM (
    SELECT c.manager_id, c.manager, active_cur, active_year,
      {nearest("active_cur / nullif(active_year, 0)", 2)} * 100e0 AS active_pct
    FROM (
      SELECT manager_id, manager, count(DISTINCT channel_id) + max(CASE WHEN channel_id IS NULL THEN 1 ELSE 0 END) AS active_cur
      FROM contracts WHERE eff_month = {NOW} GROUP BY 1, 2
    ) c LEFT JOIN year_active y ON {same("c", "y", MANAGER)}
    WHERE c.manager <> '{EXCLUDED}'
  )
)"""

HEADS = f"""
heads AS (
  SELECT superior_id, superior_name, count(*) AS heads FROM roster WHERE dept_l6 = '{BRANCH}' GROUP BY 1, 2
)"""

NEW_STORES = f"""
new_stores AS (
  SELECT *, {points("new_rank", (12, 9, 6, 3), 0)} AS new_score FROM (
    SELECT *, {ranked("new_per_head_pct", "DESC", ["supervisor_id", "supervisor"])} AS new_rank FROM (
      SELECT supervisor_id, supervisor, new_stores, heads,
        {nearest("new_stores / nullif(heads, 0) * 100e0", 1)} AS new_per_head_pct
      FROM (
        SELECT supervisor_id, supervisor, count(*) AS new_stores FROM channels
        WHERE strftime(open_date, '%Y%m') = '{NOW}' GROUP BY 1, 2
      ) LEFT JOIN heads ON supervisor_id IS NOT DISTINCT FROM superior_id AND supervisor IS NOT DISTINCT FROM superior_name
    )
  )
)"""

FAST_TEST = (
    "eff_date >= DATE '1995-01-01' AND (instant_type = '固定比例' OR flash_choice <> '' "
    "OR sure_pass_type IS NOT NULL) AND app_id > 0"
)

FAST = f"""
fast AS (SELECT manager_id, manager, count(*) AS fast_cnt FROM contracts WHERE {FAST_TEST} GROUP BY 1, 2)"""

OVERDUE = f"""
overdue AS (
  SELECT *, {points("overdue_rank", (15, 10, 5), 20)} AS overdue_score FROM (
    SELECT *, {ranked("overdue_rate", "ASC", MANAGER)} AS overdue_rank FROM (
      SELECT o.manager_id, o.manager, overdue_cnt, fast_cnt,
        {nearest("overdue_cnt / nullif(fast_cnt, 0) * 100e0", 1)} AS overdue_rate
      FROM (SELECT manager_id, manager, count(*) AS overdue_cnt FROM contracts
            WHERE {FAST_TEST} AND overdue_days >= 1 GROUP BY 1, 2) o
      LEFT JOIN fast f ON {same("o", "f", MANAGER)}
    )
  )
)"""


def month_pair(name, test, out):
    return f"""
{name}_pair AS (
  SELECT manager_id, manager,
    max(CASE WHEN eff_month = {BEFORE} THEN n END) AS {out}_prev,
    max(CASE WHEN eff_month = {NOW} THEN n END) AS {out}_cur
  FROM (SELECT eff_month, manager_id, manager, count(*) AS n FROM contracts WHERE {test} GROUP BY 1, 2, 3)
  WHERE eff_month IN ({NOW}, {BEFORE}) GROUP BY 1, 2
)"""


GROWTH = "(({0}_cur / nullif({0}_prev, 0)) - 1e0) * 100e0"


def lcv(within):
    return month_pair("lcv", "is_lcv = '是' AND vehicle_type = '新车'", "lcv") + f""",
lcv AS (
  SELECT *, {points("lcv_rank", (20, 15, 10, 5), 0)} AS lcv_score FROM (
    SELECT *, {ranked("lcv_mom_pct", "DESC", MANAGER, within)} AS lcv_rank FROM (
      SELECT *, {nearest(GROWTH.format("lcv"), 1)} AS lcv_mom_pct FROM lcv_pair
    )
  )
)"""


LCV, LCV_GLOBAL = lcv("manager_id"), lcv("")

PARTNERS_GLOBAL = f"""
partners AS (
  SELECT *, {points("partner_rank", (10, 7.5, 5, 2.5), 0)} AS partner_score FROM (
    SELECT *, {ranked("partner_cur", "DESC", MANAGER)} AS partner_rank FROM (
      SELECT manager_id, manager, count(*) AS partner_cur FROM contracts
      WHERE partner = '{PARTNER}' AND vehicle_type = '新车' AND eff_month = {NOW} GROUP BY 1, 2
    )
  )
)"""

PARTNERS = f"""
partners AS (
  SELECT manager_id, manager, count(*) AS partner_cur, CAST(1 AS INTEGER) AS partner_rank, 10e0 AS partner_score
  FROM contracts WHERE partner = '{PARTNER}' AND vehicle_type = '新车' AND eff_month = {NOW} GROUP BY 1, 2
)"""

USED = month_pair("used", "fin_amt <= 6 AND vehicle_type = '二手车'", "used") + f""",
used AS (
  SELECT *, {points("used_rank", (20, 15, 10, 5), 0)} AS used_score FROM (
    SELECT *, {ranked("used_mom_pct", "DESC", MANAGER)} AS used_rank FROM (
      SELECT *, CASE WHEN used_prev IS NULL AND used_cur IS NOT NULL THEN 100e0
        WHEN used_prev = 0 AND used_cur = 0 THEN 0e0
        ELSE {nearest(GROWTH.format("used"), 1)} END AS used_mom_pct
      FROM used_pair WHERE manager <> '{EXCLUDED}'
    )
  )
)"""

SCORES = {
    "active": ["active_cur", "active_year", "active_pct", "active_score"],
    "new_stores": ["new_stores", "heads", "new_per_head_pct", "new_rank", "new_score"],
    "overdue": ["overdue_cnt", "fast_cnt", "overdue_rate", "overdue_rank", "overdue_score"],
    "lcv": ["lcv_prev", "lcv_cur", "lcv_mom_pct", "lcv_rank", "lcv_score"],
    "partners": ["partner_cur", "partner_rank", "partner_score"],
    "used": ["used_prev", "used_cur", "used_mom_pct", "used_rank", "used_score"],
}

CARD = f"""
card AS (
  SELECT *, (active_score + new_score) * 0.3e0 + overdue_score + lcv_score + partner_score + used_score AS total_score
  FROM (
    SELECT a.manager_id, a.manager,
      {", ".join(f"coalesce({t}.{c}, 0) AS {c}" for t, names in SCORES.items() for c in names)}
    FROM active a
    JOIN active ON {same("a", "active", MANAGER)}
    LEFT JOIN new_stores ON a.manager_id IS NOT DISTINCT FROM supervisor_id AND a.manager IS NOT DISTINCT FROM supervisor
    {" ".join(f"LEFT JOIN {t} ON {same('a', t, MANAGER)}" for t in ("overdue", "lcv", "partners", "used"))}
  )
)"""

DETAIL = f"""
overdue_rows AS (
  SELECT overdue_level, paid_terms, product, channel_id, store_entity, CAST(app_id AS VARCHAR) AS app_id,
    strftime(apply_date, '%Y-%m-%d') AS apply_date, remaining_principal, fin_amt, customer_name, advisor, manager,
    eff_date, app_id AS app_no
  FROM contracts WHERE {FAST_TEST} AND overdue_days >= 1
)"""


def with_(*parts, select):
    return "WITH " + ",".join(parts) + "\n" + select


_C = (BASE, CONTRACTS)
_F = (*_C, PREAPPS, LOOKUP, ENRICHED, PRE_CELLS, APPLY_CELLS, EFF_CELLS, FUNNEL)
_S = (CHANNELS, STORES, BRAND_STORES)
_K = (*_C, CHANNELS, ROSTER, YEAR_ACTIVE, ACTIVE, HEADS, NEW_STORES, FAST, OVERDUE, LCV, PARTNERS, USED, CARD)
_STEADY = "* REPLACE (round(eff_amt, 6) AS eff_amt)"
_KEY_ORDER = ", ".join(f"{k} ASC NULLS LAST" for k in KEYS)

QUERIES: dict[str, str] = {
    "clean_contracts": with_(*_C, select=f"SELECT {texts('apply_date', 'eff_date')} FROM contracts"),
    "clean_preapprovals": with_(BASE, PREAPPS, select=f"SELECT {texts('preapp_date', 'apply_date')} FROM preapps"),
    "clean_channels": with_(CHANNELS, select=f"SELECT {texts('open_date', 'close_date')} FROM channels"),
    "clean_visits": f"""
SELECT CAST(date_trunc('second', ts) AS VARCHAR) AS visit_start,
  CAST(date_trunc('second', ts) + INTERVAL 1 SECOND * CAST(floor(value * 60e0) AS BIGINT) AS VARCHAR) AS visit_end,
  value AS visit_minutes, {stripped("'user_' || user_id || '(' || event_type || ')'")} AS visitor,
  {stripped("event_type || '（' || user_id || '）'")} AS supervisor
FROM events""",
    "contract_lookup": with_(*_C, LOOKUP, select=f"SELECT {texts('eff_date')} FROM lookup"),
    "preapp_enriched": with_(
        *_C, PREAPPS, LOOKUP,
        """numbered AS (SELECT *, row_number() OVER () AS row_no FROM preapps),
enriched AS (
  SELECT numbered.*, lookup.eff_date, lookup.app_status, lookup.prod_class, count(*) AS copies
  FROM numbered LEFT JOIN lookup ON numbered.app_id IS NOT DISTINCT FROM lookup.app_id GROUP BY ALL
)""",
        select=f"SELECT {texts('preapp_date', 'apply_date', 'eff_date').replace('*', '* EXCLUDE (row_no)', 1)} FROM enriched",
    ),
    "preapp_weighted": with_(
        *_C, PREAPPS, LOOKUP, ENRICHED, WEIGHTED, select=f"SELECT {texts('preapp_date', 'apply_date')} FROM weighted"
    ),
    "preapp_cells": with_(*_C, PREAPPS, LOOKUP, ENRICHED, PRE_CELLS, select="SELECT * FROM pre_cells"),
    "apply_cells": with_(*_C, PREAPPS, LOOKUP, ENRICHED, APPLY_CELLS, select="SELECT * FROM apply_cells"),
    "effective_cells": with_(*_C, EFF_CELLS, select=f"SELECT {_STEADY} FROM eff_cells"),
    "funnel": with_(*_F, select=f"SELECT {_STEADY} FROM funnel"),
    "funnel_top4": with_(
        *_F,
        select=f"SELECT {_STEADY} FROM funnel "
        f"ORDER BY CASE WHEN preapp_cnt IS NOT NULL THEN 0 WHEN apply_cnt IS NOT NULL THEN 1 ELSE 2 END, {_KEY_ORDER} LIMIT 4",
    ),
    "brand_stores": with_(*_S, select="SELECT * FROM brand_stores"),
    "brand_stores_stacked": with_(STORES, select="SELECT brand, store_name, address, position FROM stores"),
    "brand_choices": with_(STORES, select="SELECT brand, min(position) AS first_position FROM stores GROUP BY 1"),
    "brand_month_report": with_(
        *_F, *_S, MONTH_DETAIL, select="SELECT * FROM detail UNION ALL BY NAME SELECT * FROM total"
    ),
    "brand_month_total": with_(*_F, *_S, MONTH_DETAIL, select="SELECT * FROM total"),
    "brand_months": with_(
        *_F, *_S, ALL_MONTHS,
        select=f"SELECT brand, {cols(STORE)}, nullif(month, 'null') AS month, eff_cnt, "
        f"CASE WHEN month <> 'null' THEN {level('eff_cnt')} END AS level FROM cells",
    ),
    "brand_months_tables": with_(
        *_F, *_S, EVERY_ALL_MONTHS,
        select=f"SELECT report_brand, brand, {cols(STORE)}, nullif(month, 'null') AS month, eff_cnt, "
        f"CASE WHEN month <> 'null' THEN {level('eff_cnt')} END AS level FROM cells",
    ),
    "brand_all_months": with_(
        *_F, *_S, ALL_MONTHS, select=f"PIVOT cells ON month USING max(eff_cnt) GROUP BY brand, {cols(STORE)}"
    ),
    "brand_month_levels": with_(
        *_F, *_S, ALL_MONTHS,
        # The level of every month; the count of what has no month stays as it is.
        """levels AS (
  SELECT * REPLACE (CASE WHEN month = 'null' THEN eff_cnt WHEN eff_cnt <= 1 THEN 1 WHEN eff_cnt <= 2 THEN 2
    WHEN eff_cnt > 2 THEN 3 END AS eff_cnt) FROM cells
)""",
        select=f"PIVOT levels ON month USING CAST(max(eff_cnt) AS INTEGER) GROUP BY brand, {cols(STORE)}",
    ),
    "brand_month_reports": with_(
        *_F, *_S, EVERY_MONTH_DETAIL, select="SELECT * FROM detail UNION ALL BY NAME SELECT * FROM total"
    ),
    "brand_all_months_tables": with_(
        *_F, *_S, EVERY_ALL_MONTHS,
        select=f"PIVOT cells ON month USING max(eff_cnt) GROUP BY report_brand, brand, {cols(STORE)}",
    ),
    "active_channels_year": with_(*_C, YEAR_ACTIVE, select="SELECT * FROM year_active"),
    "active_store_score": with_(*_C, YEAR_ACTIVE, ACTIVE, select="SELECT * FROM active"),
    "channel_months": with_(
        *_C, select="SELECT DISTINCT manager_id, manager, channel_id, eff_month FROM contracts WHERE eff_month IS NOT NULL"
    ),
    "active_channels_year_merged": with_(*_C, YEAR_ACTIVE, select="SELECT * FROM year_active"),
    "active_store_score_merged": with_(*_C, YEAR_ACTIVE, ACTIVE, select="SELECT * FROM active"),
    "team_headcount": with_(ROSTER, HEADS, select="SELECT * FROM heads"),
    "new_store_score": with_(CHANNELS, ROSTER, HEADS, NEW_STORES, select="SELECT * FROM new_stores"),
    "fast_track_count": with_(*_C, FAST, select="SELECT * FROM fast"),
    "overdue_score": with_(*_C, FAST, OVERDUE, select="SELECT * FROM overdue"),
    "lcv_score": with_(*_C, LCV, select="SELECT * FROM lcv"),
    "partner_score": with_(*_C, PARTNERS, select="SELECT * FROM partners"),
    "lcv_score_global": with_(*_C, LCV_GLOBAL, select="SELECT * FROM lcv"),
    "partner_score_global": with_(*_C, PARTNERS_GLOBAL, select="SELECT * FROM partners"),
    "used_small_score": with_(*_C, USED, select="SELECT * FROM used"),
    "scorecard": with_(*_K, select="SELECT * FROM card"),
    "scorecard_top4": with_(*_K, select="SELECT * FROM card ORDER BY manager_id NULLS LAST, manager NULLS LAST LIMIT 4"),
    "overdue_detail": with_(*_C, DETAIL, select="SELECT * EXCLUDE (eff_date, app_no) FROM overdue_rows"),
    "overdue_top10": with_(
        *_C, DETAIL,
        select="SELECT * EXCLUDE (eff_date, app_no) FROM overdue_rows ORDER BY eff_date DESC NULLS LAST, app_no NULLS LAST, "
        "overdue_level NULLS LAST, paid_terms NULLS LAST, product NULLS LAST, channel_id NULLS LAST, store_entity NULLS LAST, "
        "apply_date NULLS LAST, remaining_principal NULLS LAST, fin_amt NULLS LAST, customer_name NULLS LAST, "
        "advisor NULLS LAST, manager NULLS LAST LIMIT 10",
    ),
}

#: The all-months tables with a fixed list of months, as they are registered; above, the months come from the data.
FIXED_MONTHS: dict[str, str] = {
    "brand_all_months": with_(
        *_F, *_S, ALL_MONTHS, select=f"SELECT brand, {cols(STORE)}, {by_month()} FROM cells GROUP BY brand, {cols(STORE)}"
    ),
    "brand_month_levels": with_(
        *_F, *_S, ALL_MONTHS,
        # The level of every month; the count of what has no month stays as it is.
        select=f"""SELECT * REPLACE ({", ".join(f'{level(chr(34) + m + chr(34))} AS "{m}"' for m in MONTHS[:-1])})
FROM (SELECT brand, {cols(STORE)}, {by_month()} FROM cells GROUP BY brand, {cols(STORE)})""",
    ),
    "brand_all_months_tables": with_(
        *_F, *_S, EVERY_ALL_MONTHS,
        select=f"SELECT report_brand, brand, {cols(STORE)}, {by_month()} FROM cells GROUP BY report_brand, brand, {cols(STORE)}",
    ),
}
