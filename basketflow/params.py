"""Parameters of the detection, kept out of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

NS = 1_000_000_000
MINUTE_NS = 60 * NS


@dataclass(frozen=True)
class Calendar:
    """Trigger minutes: every minute of the given local hours."""

    hours: tuple[int, ...] = (9, 10, 11, 13, 14)
    utc_offset_hours: int = 7
    lookback_minutes: int = 5
    # Optional bounds in epoch minutes: triggers after the first, up to and
    # including the second. A live run sets them to the minutes just closed.
    after_minute: int | None = None
    upto_minute: int | None = None

    def __post_init__(self):
        # Snapshot membership of a row is held in the bits of one BIGINT.
        if not 1 <= self.lookback_minutes <= 58:
            raise ValueError("lookback_minutes must lie in 1..58")


@dataclass(frozen=True)
class BucketParams:
    """Shape of the lot-bucket table."""

    start: float = 0.02
    stop: float = 100.0
    num: int = 22
    step: float = 0.2
    growth: float = 1.1167
    int_threshold: float = 7.0
    first_center: float | None = 0.25

    def __post_init__(self):
        if self.start <= 0 or self.stop <= self.start:
            raise ValueError("start must be positive and stop > start")
        if self.num < 2:
            raise ValueError("num must be >= 2")
        if self.growth <= 0:
            raise ValueError("growth must be > 0")


@dataclass(frozen=True)
class DetectionParams:
    """Thresholds of one detection run."""

    seconds_early: int = 16
    tolerance: float = 0.3633
    seconds_gap: int = 45
    min_unique: int = 15
    min_segment: int = 7
    core_threshold: int = 8
    shift_seconds: int = 45
    live: bool = True
    # Hours added to a tick's clock before it is compared with the local
    # cut-off. 0 compares UTC with local time, so a live run drops nothing.
    eligibility_offset_hours: int = 0
    calendar: Calendar = field(default_factory=Calendar)
    buckets: BucketParams = field(default_factory=BucketParams)
