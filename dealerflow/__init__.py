"""Dealer-channel funnel and finance-manager scorecard on Spark DataFrames."""

from dealerflow.params import ReportParams

__all__ = ["ReportParams"]
