"""The standard workload: forty legal requests a family, twenty illegal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import state
from .plans.admission import QuerySpec
from .plans.contract import Contract

# Lengths of windows in buckets, None for all; requests a family.
WINDOWS, EACH = (60, 360, 1440, 10080, None), 40


def span(contract: Contract, least: int, greatest: int) -> tuple[int, int]:
    w = contract.bucket_ns
    return least // w * w, (greatest // w + 1) * w


def first_values(cells_by_family: dict[str, DataFrame], contract: Contract) -> dict[tuple[str, str], list[str | None]]:
    """Two first values, nulls first, of the first two dimensions of each family."""
    out = {}
    for f in contract.families:
        for d in f.dimensions[:2]:
            rows = cells_by_family[f.name].select(state.quoted(d).alias("v")).distinct().orderBy(F.col("v").asc_nulls_first()).limit(2).collect()
            out[f.name, d] = [r["v"] for r in rows]
    return out


def legal(contract: Contract, least: int, greatest: int, values: dict[tuple[str, str], list[str | None]]) -> list[QuerySpec]:
    start, end = span(contract, least, greatest)
    out = []
    for f in contract.families:
        for i in range(EACH):
            length = WINDOWS[i % len(WINDOWS)]
            begin = start if length is None else max(start, end - length * contract.bucket_ns)
            first = f.dimensions[0]
            second = f.dimensions[1] if len(f.dimensions) > 1 else first
            filtered = {0: {}, 1: {first: 1}, 2: {first: 1, second: 1}, 3: {first: 2}}[i // 10]
            filters = {d: values[f.name, d][:n] for d, n in filtered.items() if values[f.name, d]}
            measures = (f.measures[0].name,) if i % 3 == 0 else ()
            out.append(QuerySpec(f.name, begin, end, filters, f.dimensions[: 1 + i % len(f.dimensions)], measures))
    return out


def illegal(contract: Contract, least: int, greatest: int) -> list[QuerySpec]:
    start, end = span(contract, least, greatest)
    name = contract.families[0].name
    shapes = [
        QuerySpec("undeclared-family", start, end),
        QuerySpec(name, start + 1, end),
        QuerySpec(name, start, end, group_by=("undeclared_dimension",)),
        QuerySpec(name, start, end, filters={"service": []}),
        QuerySpec(name, start, end, measures=("undeclared:sum",)),
    ]
    return [shapes[i % len(shapes)] for i in range(20)]
