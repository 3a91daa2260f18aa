"""Dates and spans as the filter language writes them."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

_RELATIVE = re.compile(r"(today|now)(?:([+-])(\d+)([hdwmy]))?")
_SPAN = re.compile(r"(?:(\d+)d)?((?:\d+(?:\.\d*)?(?:ms|us|ns|h|m|s))*)")
_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
MOST_DAYS = 1_000_000


def relative(text: str, now: datetime) -> datetime | None:
    """today or now, moved by hours, days, weeks, months or years; a month's last day stands in for days it lacks."""
    m = _RELATIVE.fullmatch(text)
    if not m:
        return None
    at = now.replace(hour=0, minute=0, second=0, microsecond=0) if m[1] == "today" else now
    if not m[2]:
        return at
    n, unit = int(m[2] + m[3]), m[4]
    if unit in "hdw":
        return at + timedelta(**{{"h": "hours", "d": "days", "w": "weeks"}[unit]: n})
    year, month = divmod(at.year * 12 + at.month - 1 + (n if unit == "m" else 12 * n), 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def stored(at: datetime, kind: str) -> str:
    """As property values are stored: a date as it is on its own clock, an instant in UTC."""
    if kind == "date":
        return at.strftime("%Y-%m-%d")
    return (at if at.tzinfo is None else at.astimezone(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def span(text: str) -> timedelta | None:
    """7d, 48h30m, 1d2h; None for what is no span above zero."""
    m = _SPAN.fullmatch(text)
    if not text or not m or (m[1] and int(m[1]) > MOST_DAYS):
        return None
    seconds = sum(float(n) * _SECONDS[u] for n, u in re.findall(r"(\d+(?:\.\d*)?)(ms|us|ns|h|m|s)", m[2]))
    out = timedelta(days=int(m[1] or 0), seconds=seconds)
    return out if out > timedelta(0) else None


def instant(text: str) -> datetime | None:
    """A date or a time in ISO form; UTC where no zone is given."""
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at
