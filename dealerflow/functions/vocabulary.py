"""Words the extracts carry and labels the reports print."""

CANCELLED = "订单已取消"
AUTO_PASS = "自动通过"
PASS = "通过"
YES = "是"
FIXED_RATIO = "固定比例"
NEW_VEHICLE = "新车"
USED_VEHICLE = "二手车"
PARTNER_PROJECT = "理想汽车"
TOTAL_LABEL = "合计"

MISSING_TEXT = "NA"

# Points by rank; any other rank takes the last number.
NEW_STORE_POINTS = ((12.0, 9.0, 6.0, 3.0), 0.0)
OVERDUE_POINTS = ((15.0, 10.0, 5.0), 20.0)
LCV_POINTS = ((20.0, 15.0, 10.0, 5.0), 0.0)
PARTNER_POINTS = ((10.0, 7.5, 5.0, 2.5), 0.0)
USED_POINTS = ((20.0, 15.0, 10.0, 5.0), 0.0)

# Amounts are reported in units of 10 000; a used-car contract
# is small up to 6 units.
AMOUNT_UNIT = 10000.0
SMALL_AMOUNT = 6.0
