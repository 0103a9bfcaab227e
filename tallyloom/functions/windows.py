"""Time windows as users write them. ``now`` is always given."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

DISPLAY = timedelta(hours=8)


def parse(text: str, now: datetime, until: bool = False, from_user: bool = False) -> datetime | None:
    """UTC time of "24h", "7d", an ISO time or a date.

    A time with an offset is exact; one without is UTC, or display time where a user wrote it. A date alone as an upper
    bound is its last microsecond. Anything else is None, which bounds nothing.
    """
    text = (text or "").strip()
    if m := re.fullmatch(r"(\d+)([hd])", text):
        return now - (timedelta(hours=int(m[1])) if m[2] == "h" else timedelta(days=int(m[1])))
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    if until and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        at += timedelta(days=1) - timedelta(microseconds=1)
    if at.tzinfo:
        return at.astimezone(UTC).replace(tzinfo=None)
    return at - DISPLAY if from_user else at
