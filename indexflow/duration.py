"""Lengths of time written in ISO 8601 or in words."""

from __future__ import annotations

import datetime
import re
from fractions import Fraction

#: Microseconds of a unit: a year is 365 days, a month 30, a week 7.
DAY = 86_400_000_000
ISO_DATE = {"Y": 365 * DAY, "M": 30 * DAY, "W": 7 * DAY, "D": DAY}
ISO_TIME = {"H": 3_600_000_000, "M": 60_000_000, "S": 1_000_000}
WORDS = {"day": DAY, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}
NUMBER = re.compile(r"(\d+(?:\.\d+)?)([A-Z])", re.A)
PAIR = re.compile(r"(-?\d+)\s+([A-Za-z]+)", re.A)


def _part(text: str, units: dict[str, int], whole: str) -> Fraction:
    at, total, last = 0, Fraction(0), -1
    order = list(units)
    while at < len(text):
        m = NUMBER.match(text, at)
        if not m or m[2] not in units or order.index(m[2]) < last:
            raise ValueError(f"{whole!r} is no ISO 8601 duration, at {text[at:]!r}")
        last = order.index(m[2])
        total += Fraction(m[1]) * units[m[2]]
        at = m.end()
    return total


def parse_micros(text: str) -> int:
    """Microseconds of ``[-]P[nY][nM][nW][nD][T[nH][nM][nS]]`` or of number and unit pairs such as ``1 day 2 hours``."""
    body = text.strip()
    sign, iso = (-1, body[1:]) if body.startswith("-P") else (1, body)
    if iso.startswith("P"):
        date, t, time = iso[1:].partition("T")
        if not date and not time or t and not time:
            raise ValueError(f"{text!r} names no length of time")
        return sign * int(_part(date, ISO_DATE, text) + _part(time, ISO_TIME, text))
    at, total = 0, 0
    while at < len(body):
        m = PAIR.match(body, at)
        unit = m and WORDS.get(m[2].lower().removesuffix("s"))
        if not unit:
            raise ValueError(f"{text!r} is no duration, at {body[at:]!r}")
        total += int(m[1]) * unit
        at = m.end()
        gap = re.compile(r"\s+").match(body, at)
        if at < len(body) and not gap:
            raise ValueError(f"{text!r} is no duration, at {body[at:]!r}")
        at = gap.end() if gap else at
    if not at:
        raise ValueError("an empty text is no duration")
    return total


def parse_duration(text: str) -> datetime.timedelta:
    return datetime.timedelta(microseconds=parse_micros(text))


def format_duration(d: datetime.timedelta) -> str:
    """ISO 8601, in hours, minutes and seconds."""
    micros = d // datetime.timedelta(microseconds=1)
    sign, micros = ("-" if micros < 0 else ""), abs(micros)
    hours, rest = divmod(micros, ISO_TIME["H"])
    minutes, rest = divmod(rest, ISO_TIME["M"])
    seconds = f"{rest // 1_000_000}.{rest % 1_000_000:06d}".rstrip("0").rstrip(".")
    text = "".join((f"{hours}H" if hours else "", f"{minutes}M" if minutes else "", f"{seconds}S" if seconds != "0" else ""))
    return f"{sign}PT{text or '0S'}"
