"""Mergeable aggregate state: for each measure, columns of a cell, their merging, and the answer.

Cells hold only what the operation needs. Counts and bins are 64-bit; sums are decimal while they are
added up, so that the result doesn't depend on order, and are cast back with a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bucket_start, checked_sum, one_of
from ..plans.admission import QuerySpec
from ..plans.contract import ATTRIBUTE, Measure

BUCKET = "bucket_ns"


def dimension(name: str) -> Column:
    """A dimension of a canonical event; attributes by key."""
    return F.try_element_at("attributes", F.lit(name[len(ATTRIBUTE) :])) if name.startswith(ATTRIBUTE) else F.col(name)


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def stem(m: Measure) -> str:
    """The cell column of a measure; bins add their number."""
    return m.name.replace(":", "__").replace("*", "rows")


def bins(m: Measure) -> int:
    return len(m.bounds or ()) + 1


def bin_columns(m: Measure) -> list[str]:
    return [f"{stem(m)}__{i}" for i in range(bins(m))]


def cell_columns(measures: list[Measure] | tuple[Measure, ...]) -> list[str]:
    return [c for m in measures for c in (bin_columns(m) if m.op == "histogram" else [stem(m)])]


def in_bin(value: Column, bounds: tuple[int, ...], i: int) -> Column:
    """Whether a value is in bin i: as many bounds as i are at or below it."""
    ok = value.isNotNull()
    if i > 0:
        ok &= value >= bounds[i - 1]
    if i < len(bounds):
        ok &= value < bounds[i]
    return ok


def fold(m: Measure) -> list[Column]:
    """Aggregates of events into a cell."""
    v = F.col(m.field) if m.op != "count" else None
    if m.op == "count":
        return [F.count("*").alias(stem(m))]
    if m.op == "count_present":
        return [F.count(v).alias(stem(m))]
    if m.op == "sum":
        return [checked_sum(v).cast("long").alias(stem(m))]
    if m.op in ("min", "max"):
        return [(F.min if m.op == "min" else F.max)(v).alias(stem(m))]
    return [F.count_if(in_bin(v, m.bounds, i)).alias(c) for i, c in enumerate(bin_columns(m))]


def merge(m: Measure) -> list[Column]:
    """Aggregates of cells into coarser cells."""
    if m.op in ("min", "max"):
        return [(F.min if m.op == "min" else F.max)(quoted(stem(m))).alias(stem(m))]
    return [checked_sum(quoted(c)).cast("long").alias(c) for c in (bin_columns(m) if m.op == "histogram" else [stem(m)])]


def answer(m: Measure) -> Column:
    """The measure as asked for: bins as one array."""
    return (F.array(*[quoted(c) for c in bin_columns(m)]) if m.op == "histogram" else quoted(stem(m))).alias(m.name)


def cells(events: DataFrame, width: int, dimensions: tuple[str, ...] | list[str], measures: tuple[Measure, ...] | list[Measure]) -> DataFrame:
    """Events folded into cells keyed by bucket and dimensions."""
    keys = [bucket_start("timestamp_ns", width).alias(BUCKET), *[dimension(d).alias(d) for d in dimensions]]
    return events.groupBy(*keys).agg(*[c for m in measures for c in fold(m)])


def regroup(cell_table: DataFrame, group_by: tuple[str, ...] | list[str], measures: tuple[Measure, ...] | list[Measure]) -> DataFrame:
    """Cells of a subset of the dimensions; the bucket always stays."""
    return cell_table.groupBy(BUCKET, *[quoted(d) for d in group_by]).agg(*[c for m in measures for c in merge(m)])


def grouping_sets(cell_table: DataFrame, sets: list[tuple[str, ...]], measures: list[Measure]) -> DataFrame:
    """Several grouping subsets of one cell table at once; ``grouping_set`` is the set's number."""
    every = list(dict.fromkeys(d for s in sets for d in s))
    parts = F.explode(F.array(*[F.lit(i) for i in range(len(sets))]))
    wide = cell_table.withColumn("grouping_set", parts)
    for d in every:
        inside = [i for i, s in enumerate(sets) if d in s]
        wide = wide.withColumn(d, F.when(F.col("grouping_set").isin(inside), quoted(d)))
    return wide.groupBy("grouping_set", BUCKET, *[quoted(d) for d in every]).agg(*[c for m in measures for c in merge(m)])


def selected(spec: QuerySpec, time: Column, get=quoted) -> Column:
    """The rows that a request is about."""
    keep = (time >= spec.start_ns) & (time < spec.end_ns)
    for d, values in spec.filters.items():
        keep &= one_of(get(d), values)
    return keep


def ordered(df: DataFrame, group_by: tuple[str, ...] | list[str]) -> DataFrame:
    """The order of answers: bucket, then groupings, nulls first, by bytes."""
    return df.orderBy(F.col(BUCKET).asc_nulls_first(), *[quoted(d).asc_nulls_first() for d in group_by])
