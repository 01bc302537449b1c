"""Retained raw events: errors for good, others while recent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryRejected
from ..functions.values import I64_MIN, one_of
from ..plans.contract import DIMENSIONS, Retention, known_dimension
from .state import dimension

CLASSES = ("all", "recent", "errors")


def is_error(retention: Retention) -> Column:
    return one_of(F.col("severity"), list(retention.error_severities)) | one_of(F.col("status"), list(retention.error_statuses))


def cutoff_ns(retention: Retention, least: int, greatest: int) -> int:
    """From which time on non-errors are kept; those at the greatest time always are."""
    back = retention.recent_ns()
    return least if back is None else max(I64_MIN, greatest - back)


def classified(events: DataFrame, retention: Retention, cutoff: int) -> DataFrame:
    """Adds tier: errors, recent or null for events that only cells keep."""
    return events.withColumn("tier", F.when(is_error(retention), "errors").when(F.col("timestamp_ns") >= cutoff, "recent"))


def retained(errors: DataFrame, recent: DataFrame, which: str = "all") -> DataFrame:
    """Retained events of a class, by time and id."""
    if which not in CLASSES:
        raise QueryRejected(f"no such class of events: {which!r}")
    found = errors if which == "errors" else recent if which == "recent" else recent.unionByName(errors)
    return found.orderBy("timestamp_ns", "event_id")


def filtered(events: DataFrame, filters: dict[str, list[str | None]]) -> DataFrame:
    """Equality and IN on an event's text fields and attributes; unknown names are rejected."""
    for name, values in filters.items():
        if not known_dimension(name) and name != "event_id":
            raise QueryRejected(f"no such field: {name!r}; there are {', '.join(DIMENSIONS)}, event_id and attributes.*")
        events = events.where(one_of(dimension(name), values))
    return events
