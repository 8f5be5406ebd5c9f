"""Lengths of time by unit."""

from __future__ import annotations

from datetime import timedelta

#: Minutes in each unit. A month is 30.417 days and a year 365.
MINUTES = {"second": 1 / 60, "minute": 1, "hour": 60, "day": 1440, "week": 7 * 1440, "month": 30.417 * 1440, "year": 365 * 1440}


def period(value: float, unit: str) -> timedelta:
    try:
        return timedelta(minutes=value * MINUTES[unit])
    except KeyError:
        raise ValueError(f"unknown unit {unit!r}; known are {', '.join(MINUTES)}") from None
