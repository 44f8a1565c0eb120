"""Run parameters: every constant that changes a number is a field here."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime


@dataclass(frozen=True)
class Params:
    # Calendar (inclusive). An open end means the day of the run.
    calendar_start: date = date(2016, 9, 1)
    calendar_end: date | None = None
    calendar_margin_days: int = 60
    # Historical orders still open and past their promise on this day count as overdue.
    data_cutoff: date = date(2018, 10, 17)
    # Complete months used for headline numbers (inclusive).
    kpi_start: date = date(2017, 1, 1)
    kpi_end: date = date(2018, 8, 31)
    heavy_rain_mm: float = 20.0
    holiday_window_days: int = 10
    rain_window_days: int = 7
    min_orders_for_ranking: int = 30
    watchlist_factor: float = 2.0
    low_review_max: int = 2
    far_km: float = 1000.0
    # Provenance labels of the two feeds.
    historical_source: str = "marketplace"
    synthetic_source: str = "simulated"
    # Promise back-test: learn in the first period, apply in the second.
    train_start: date = date(2017, 1, 1)
    train_end: date = date(2017, 12, 31)
    test_start: date = date(2018, 1, 1)
    test_end: date = date(2018, 8, 31)
    backtest_percentiles: tuple[float, ...] = (0.8, 0.9, 0.95, 0.97)
    min_train_orders: int = 30
    # Distribution fitting.
    excluded_months: tuple[str, ...] = ("2017-11", "2017-12", "2018-02", "2018-03")
    level_start: date = date(2018, 1, 1)
    level_end: date = date(2018, 8, 31)
    event_year: int = 2017
    event_days: int = 7
    peak_start: str = "11-20"
    peak_end: str = "12-31"
    max_approval_lag: int = 7
    price_lag_months: int = 2
    # As-of views of the live feed.
    snapshot_before: datetime = datetime(2026, 10, 5, 2, 0)
    snapshot_after: datetime = datetime(2026, 10, 10, 2, 0)
    # Physical strategy (never changes a result).
    broadcast_limit_bytes: int = 64 * 1024 * 1024
    hot_key_rows: int = 2_000_000
    hot_key_sample: int = 128
    salts: int = 64
    max_hot_keys: int = 100_000  # more hot keys than this are joined, not broadcast
    bucket_bytes: int = 256 * 1024 * 1024  # of the largest table kept by order
    max_buckets: int = 100_000
    pass_bytes: int = 256 * 1024 * 1024  # of sources, from which on a stored table is made in passes
    max_passes: int = 4

    @property
    def last_calendar_day(self) -> date:
        return self.calendar_end or date.today()


# The given test tables carry orders of 1995-2001.
TABLE_PARAMS = Params(
    calendar_start=date(1995, 1, 1),
    calendar_end=date(2001, 12, 31),
    data_cutoff=date(2001, 8, 1),
    kpi_start=date(1996, 1, 1),
    kpi_end=date(2000, 12, 31),
    train_start=date(1996, 1, 1),
    train_end=date(1998, 12, 31),
    test_start=date(1999, 1, 1),
    test_end=date(2000, 12, 31),
    min_train_orders=5,
    min_orders_for_ranking=10,
    excluded_months=("1999-11", "1999-12", "2000-02", "2000-03"),
    level_start=date(2000, 1, 1),
    level_end=date(2000, 8, 31),
    event_year=1999,
    watchlist_factor=1.05,
    snapshot_before=datetime(2000, 1, 10, 2, 0),
    snapshot_after=datetime(2000, 1, 20, 2, 0),
)
