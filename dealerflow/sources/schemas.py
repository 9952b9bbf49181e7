"""Column headers of the extracts and the names used from there on."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True, eq=False)
class Extract:
    """One source file family: its name and header -> build name, in reading order.

    ``text`` lists the columns in which a blank cell is an empty string rather
    than a missing value. All other columns are parsed by the cleaning step.
    """

    name: str
    headers: dict[str, str]
    text: frozenset[str]

    @property
    def columns(self) -> list[str]:
        return list(self.headers.values())


def _extract(name: str, headers: dict[str, str], parsed: set[str]) -> Extract:
    return Extract(name, headers, frozenset(set(headers.values()) - parsed))


def plain_header(header: str) -> str:
    """A header with every character that is not a letter, digit, dot or
    underscore written as a dot, so that parentheses of either width match."""
    return re.sub(r"[^\w.]", ".", header.strip().lstrip("﻿"))


# The headers of the five extracts and the store list.
CONTRACTS = _extract(
    "contracts",
    {
        "申请编号": "app_id",
        "融资金额": "fin_amt",
        "进件日期": "apply_date",
        "合同生效日期": "eff_date",
        "金融经理名称": "manager",
        "金融顾问名称": "advisor",
        "金融经理员工工号": "manager_id",
        "渠道代码": "channel_id",
        "申请状态": "app_status",
        "店面城市": "store_city",
        "产品类别": "prod_category",
        "产品类目": "prod_class",
        "产品方案名称": "product",
        "合作项目": "partner",
        "车辆类型": "vehicle_type",
        "品牌": "brand",
        "渠道二级科目": "channel_l2",
        "店面主体": "store_entity",
        "直秒类型": "instant_type",
        "闪过选择": "flash_choice",
        "必过选择类型": "sure_pass_type",
        "最新逾期天数": "overdue_days",
        "是否LCV": "is_lcv",
        "当前逾期级别": "overdue_level",
        "已还款期数": "paid_terms",
        "当前销售口径剩余本金": "remaining_principal",
        "客户姓名": "customer_name",
    },
    {
        "app_id", "fin_amt", "apply_date", "eff_date", "manager_id", "overdue_days",
        "paid_terms", "remaining_principal",
    },
)

PREAPPROVALS = _extract(
    "preapprovals",
    {
        "申请编号": "app_id",
        "进件时间": "apply_ts",
        "预审提交时间": "preapp_date",
        "金融经理": "manager",
        "金融顾问": "advisor",
        "渠道编码": "channel_id",
        "预审结果": "preapp_result",
        "是否预审复议": "preapp_reconsidered",
        "最后一次人工审批时间": "manual_ts",
        "最后一次自动审批时间": "auto_ts",
        "最后一次人工审批结果": "manual_result",
        "最后一次自动审批结果": "auto_result",
        "店面城市": "store_city",
        "产品类别": "prod_category",
        "产品名称": "product",
        "合作项目": "partner",
        "车辆类型": "vehicle_type",
        "主品牌": "brand",
        "渠道二级科目名称": "channel_l2",
        "店面主体": "store_entity",
    },
    {"app_id", "apply_ts", "preapp_date"},
)

CHANNELS = _extract(
    "channels",
    {
        "主体名称": "entity_name",
        "渠道编号": "channel_id",
        "状态": "channel_status",
        "负责员工.金融顾问.": "owner",
        "业务上级": "supervisor",
        "业务上级工号": "supervisor_id",
        "初始生效日期": "open_date",
        "渠道关停日期": "close_date",
    },
    {"supervisor_id", "open_date", "close_date"},
)

VISITS = _extract(
    "visits",
    {
        "拜访开始时间": "visit_start",
        "拜访结束时间": "visit_end",
        "拜访用时": "visit_minutes",
        "拜访人": "visitor",
        "业务上级": "supervisor",
    },
    {"visit_start", "visit_end", "visit_minutes"},
)

ROSTER = _extract(
    "roster",
    {
        "六级部门": "dept_l6",
        "直接上级": "superior_id",
        "直接上级姓名": "superior_name",
        "姓名": "staff_name",
    },
    {"superior_id"},
)

STORES = _extract(
    "brand_stores",
    {"品牌": "brand", "店面名称": "store_name", "地址": "address"},
    set(),
)

EXTRACTS = {e.name: e for e in (CONTRACTS, PREAPPROVALS, CHANNELS, VISITS, ROSTER, STORES)}
