"""Parsers for durations, times and filters; names of measures and files."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ContractError, QueryRejected

I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1
# Nanoseconds of each duration unit.
UNIT_NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
DAY_NS = UNIT_NS["d"]


def duration_ns(text: str) -> int:
    """``<integer><unit>`` without leading zeros, in nanoseconds that fit 64 bits."""
    m = re.fullmatch(r"(0|[1-9][0-9]*)(ns|us|ms|s|m|h|d)", text if isinstance(text, str) else "")
    if not m:
        raise ContractError(f"not a duration: {text!r}")
    value = int(m[1]) * UNIT_NS[m[2]]
    if value > I64_MAX:
        raise ContractError(f"duration out of range: {text}")
    return value


def time_ns(text: str) -> int:
    """Nanoseconds since the epoch from an integer or an RFC 3339 time, to the nanosecond."""
    if re.fullmatch(r"[+-]?[0-9]+", text):
        value = int(text)
    else:
        m = re.fullmatch(r"(\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)", text)
        if not m:
            raise QueryRejected(f"not a time: {text!r}")
        try:
            at = datetime.fromisoformat(m[1].upper().replace(" ", "T") + ("+00:00" if m[3] in "Zz" else m[3]))
        except ValueError as e:
            raise QueryRejected(f"not a time: {text!r}") from e
        since = at - datetime(1970, 1, 1, tzinfo=UTC)
        value = (since.days * 86400 + since.seconds) * 10**9 + int(((m[2] or "") + "0" * 9)[:9])
    if not I64_MIN <= value <= I64_MAX:
        raise QueryRejected(f"time out of range: {text}")
    return value


def parse_filters(items: list[str]) -> dict[str, list[str | None]]:
    """``field=value[,value]`` each, the word null being null; no field twice, none without values."""
    out: dict[str, list[str | None]] = {}
    for item in items:
        field, equals, values = item.partition("=")
        if not equals or not field or not values:
            raise QueryRejected(f"not a filter: {item!r}")
        if field in out:
            raise QueryRejected(f"two filters on {field}")
        out[field] = [None if v == "null" else v for v in values.split(",")]
    return out


def measure_name(field: str, op: str) -> str:
    return "count" if op == "count" else f"{field}:{op}"


def safe_name(name: str) -> str:
    """A file name for any dimension or family; different names never meet."""
    return "".join(c if re.fullmatch(r"[A-Za-z0-9_-]", c) else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def bucket_start(timestamp: str | Column, width: int) -> Column:
    """The start of the bucket that holds a time; floor for times before the epoch too."""
    t = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return t - F.pmod(t, F.lit(width).cast("long"))


def checked_sum(column: Column) -> Column:
    """Sum of 64-bit integers that raises on overflow whatever the order, and is null of nothing."""
    return F.sum(column.cast("decimal(38,0)"))


def one_of(column: Column, values: list[str | None]) -> Column:
    """IN with null as a value."""
    some = [v for v in values if v is not None]
    out = column.isin(some) if some else F.lit(False)
    out = F.coalesce(out, F.lit(False))
    return out | column.isNull() if None in values else out
