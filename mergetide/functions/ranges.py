"""Query parameters: date ranges and bin sizes. Plain values, no data involved."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

# Relative ranges by name, in days.
PRESET_DAYS = {
    "last_seven": 7,
    "last_thirty": 30,
    "last_ninety": 90,
    "last_three_sixty_five": 365,
}
DEFAULT_DAYS = 30
# Fixed value: spans above this many days are binned by week.
DAILY_BINS_UP_TO = 70


def to_utc(value: str | datetime) -> datetime:
    """ISO-8601 text or a datetime, with offset, as naive UTC. Naive input is UTC already."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value
    return value.astimezone(timezone.utc).replace(tzinfo=None)


def start_of_day(now: datetime) -> datetime:
    return to_utc(now).replace(hour=0, minute=0, second=0, microsecond=0)


def resolve_range(
    now: datetime,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> tuple[datetime, datetime]:
    """Given bounds, else today's midnight and 30 days before the end. ``now`` is the clock."""
    last = to_utc(end) if end is not None else start_of_day(now)
    first = to_utc(start) if start is not None else last - timedelta(days=DEFAULT_DAYS)
    return first, last


def preset_range(
    preset: str,
    now: datetime,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
) -> tuple[datetime, datetime]:
    """A named range ending at today's midnight; ``absolute`` uses the bounds; unknown names mean 30 days."""
    if preset == "absolute":
        return resolve_range(now, start, end)
    last = start_of_day(now)
    return last - timedelta(days=PRESET_DAYS.get(preset, DEFAULT_DAYS)), last


def bin_unit(start: datetime, end: datetime) -> str:
    """``week`` for spans of more than 70 days (begun days count whole), else ``day``."""
    days = math.ceil(abs((end - start) / timedelta(days=1)))
    return "week" if days > DAILY_BINS_UP_TO else "day"
