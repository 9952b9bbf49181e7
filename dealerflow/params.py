"""Everything a report depends on besides its tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from dealerflow.functions import vocabulary as words


@dataclass(frozen=True)
class ReportParams:
    """Arguments of one report run; no operator reads the clock.

    ``rank_scope``: ``"manager"`` ranks the two sales KPIs inside each manager
    (everyone is first), ``"global"`` ranks managers against each other.
    ``prev``: ``"minus30"`` takes the month of ``as_of`` minus 30 days,
    ``"add_months"`` the calendar month before.
    ``blank_is_missing``: whether a blank sure-pass type counts as absent.
    ``year``, ``cutoff`` and ``label_month`` default from ``as_of``.
    """

    as_of: date
    brand: str | None = None
    branch: str | None = None
    partner: str = words.PARTNER_PROJECT
    excluded: tuple[str, ...] = ()
    year: int | None = None
    cutoff: date | None = None
    label_month: str | None = None
    rank_scope: str = "manager"
    prev: str = "minus30"
    blank_is_missing: bool = False

    def __post_init__(self) -> None:
        if self.rank_scope not in ("manager", "global"):
            raise ValueError(f"rank_scope must be 'manager' or 'global', not {self.rank_scope!r}")
        if self.prev not in ("minus30", "add_months"):
            raise ValueError(f"prev must be 'minus30' or 'add_months', not {self.prev!r}")

    def need(self, name: str) -> str:
        """A parameter without which the report would silently be empty."""
        value = getattr(self, name)
        if value is None:
            raise ValueError(f"this report needs the parameter {name!r}")
        return value

    @property
    def month(self) -> str:
        return f"{self.as_of:%Y%m}"

    @property
    def prev_month(self) -> str:
        if self.prev == "minus30":
            return f"{self.as_of - timedelta(days=30):%Y%m}"
        return f"{self.as_of.replace(day=1) - timedelta(days=1):%Y%m}"

    @property
    def active_year(self) -> int:
        return self.year if self.year is not None else self.as_of.year - 1

    @property
    def fast_track_from(self) -> date:
        return self.cutoff or date(self.as_of.year - 1, 1, 1)

    @property
    def total_month(self) -> str:
        return self.label_month or f"{self.as_of - timedelta(days=20):%Y%m}"
