"""The time grammar: ``0``, ``5m``, ``10m:``, ``1h:5m``.

Durations are microseconds in a bigint column. Every function has a column form; ``parse`` is
the driver-side form for the few expressions that become window frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of the grammar and their length in microseconds (a year is 365 days).
UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "y": 31_536_000_000_000,
}
NUMBER = r"\d+(?:\.\d+)?"
TERM = rf"({NUMBER})(us|ms|s|m|h|d|y)"
WHOLE = rf"^(?:{NUMBER}(?:us|ms|s|m|h|d|y))+$"
# Longest duration a bigint of microseconds holds, in whole days.
MAX_US = 106_751_991 * UNIT_US["d"]


def _unit_factor(unit: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in UNIT_US.items() for v in pair])
    return F.element_at(table, unit)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def duration_us(text: Column, strict: bool = True, allow_negative: bool = False) -> Column:
    """Length of a duration text; null where it does not parse."""
    trimmed = F.trim(text)
    body = F.trim(F.regexp_replace(trimmed, r"^-", ""))
    terms = F.zip_with(
        F.regexp_extract_all(body, F.lit(TERM), F.lit(1)),
        F.regexp_extract_all(body, F.lit(TERM), F.lit(2)),
        lambda number, unit: F.rint(number.cast("double") * _unit_factor(unit)),
    )
    total = F.when(body.isin("", "0"), F.lit(0.0)).when(
        body.rlike(WHOLE if strict else TERM), F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    )
    size = _let(total, lambda t: F.when(t <= F.lit(float(MAX_US)), t.cast("bigint")))
    sign = F.when(~trimmed.startswith("-"), F.lit(1)).otherwise(F.lit(-1 if allow_negative else None).cast("int"))
    return size * sign


def interval(text: Column, strict: bool = True, allow_negative: bool = False) -> Column:
    """struct<start_us, end_us, is_interval>; null where the expression does not parse."""
    trimmed = F.trim(text)
    is_interval = trimmed.contains(":")
    halves = F.split(trimmed, ":", 2)
    head = F.get(halves, F.lit(0))
    start = F.when(F.trim(head) != "", duration_us(head, strict, allow_negative))
    end = F.when(is_interval, duration_us(F.get(halves, F.lit(1)), strict, allow_negative))
    return _let(
        F.struct(start.alias("start_us"), end.alias("end_us"), is_interval.alias("is_interval")),
        lambda t: F.when(t["start_us"].isNotNull() & (~t["is_interval"] | t["end_us"].isNotNull()), t),
    )


def is_interval(parsed: Column) -> Column:
    return parsed.getField("is_interval")


def is_point(parsed: Column) -> Column:
    return ~parsed.getField("is_interval")


def range_us(parsed: Column) -> Column:
    """Start minus end; zero for a point."""
    return _let(
        parsed,
        lambda t: F.when(t["is_interval"], t["start_us"] - t["end_us"]).when(t.isNotNull(), F.lit(0).cast("bigint")),
    )


def window_samples(length_us: Column, granularity_us: int) -> Column:
    """Whole samples in a window; null when there is none."""
    samples = F.floor(length_us / F.lit(granularity_us))
    return F.when(samples > 0, samples)


def _text(us: Column) -> Column:
    size = F.abs(us)

    def part(unit: str, modulus: int | None) -> Column:
        count = F.floor(size / F.lit(UNIT_US[unit]))
        if modulus:
            count = F.pmod(count, F.lit(modulus))
        return F.when(count > 0, F.concat(count.cast("string"), F.lit(unit))).otherwise("")

    parts = F.concat(
        part("y", None), part("d", 365), part("h", 24), part("m", 60), part("s", 60), part("ms", 1000), part("us", 1000)
    )
    sign = F.when(us < 0, "-").otherwise("")
    return F.when(us == 0, F.lit("0")).when(us.isNotNull(), F.concat(sign, parts))


def duration_text(us: Column) -> Column:
    """Canonical text: years, days, hours, minutes, seconds, ms, us without the zero parts."""
    return _let(us, _text)


def interval_text(parsed: Column) -> Column:
    def write(t: Column) -> Column:
        start = duration_text(t["start_us"])
        return F.when(t["is_interval"], F.concat(start, F.lit(":"), duration_text(t["end_us"]))).otherwise(start)

    return _let(parsed, write)


@dataclass(frozen=True, order=True)
class Duration:
    """A duration on the driver, with the arithmetic of the grammar."""

    us: int

    def __add__(self, other: Duration) -> Duration:
        return Duration(self.us + other.us)

    def __sub__(self, other: Duration) -> Duration:
        return Duration(self.us - other.us)

    def __neg__(self) -> Duration:
        return Duration(-self.us)

    def __abs__(self) -> Duration:
        return Duration(abs(self.us))

    def __bool__(self) -> bool:
        return self.us != 0

    def __int__(self) -> int:
        return int(self.us / 1e6)

    def __float__(self) -> float:
        return self.us / 1e6

    @classmethod
    def parse(cls, text: str, strict: bool = True, allow_negative: bool = False) -> Duration:
        body = text.strip()
        sign = -1 if body.startswith("-") else 1
        body = body[1:].strip() if sign < 0 else body
        if body in ("", "0"):
            return cls(0)
        terms = re.findall(TERM, body)
        if not terms or (strict and not re.match(WHOLE, body)):
            raise ValueError(f"not a duration: {text!r}")
        total = sign * sum(round(float(number) * UNIT_US[unit]) for number, unit in terms)
        if abs(total) > MAX_US:
            raise ValueError(f"duration too long: {text!r}")
        if total < 0 and not allow_negative:
            raise ValueError(f"negative duration: {text!r}")
        return cls(total)


@dataclass(frozen=True)
class Interval:
    """A parsed time expression on the driver; ``end`` is None for a point."""

    start: Duration
    end: Duration | None = None

    @property
    def is_interval(self) -> bool:
        return self.end is not None

    @property
    def length(self) -> Duration:
        return self.start - self.end if self.end is not None else Duration(0)

    @classmethod
    def parse(cls, text: str, strict: bool = True, allow_negative: bool = False) -> Interval:
        head, colon, tail = text.strip().partition(":")
        if not head.strip():
            raise ValueError(f"no start in time expression: {text!r}")
        start = Duration.parse(head, strict, allow_negative)
        return cls(start, Duration.parse(tail, strict, allow_negative) if colon else None)
