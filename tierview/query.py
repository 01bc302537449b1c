"""Answers: from views, and from raw events as their check."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import state
from .plans import layout as layouts
from .plans.admission import QuerySpec, admit, wanted
from .plans.contract import Contract


def _finish(cells: DataFrame, spec: QuerySpec, measures: list, order: bool = True) -> DataFrame:
    out = cells.select(state.BUCKET, *[state.quoted(d) for d in spec.group_by], *[state.answer(m) for m in measures])
    return state.ordered(out, spec.group_by) if order else out


def over_cells(cells: DataFrame, contract: Contract, spec: QuerySpec, order: bool = True) -> DataFrame:
    """The answer from a cell table that has the family's dimensions and measures."""
    measures = wanted(admit(contract, spec), spec)
    return _finish(state.regroup(cells.where(state.selected(spec, F.col(state.BUCKET))), spec.group_by, measures), spec, measures, order)


def from_views(archive, spec: QuerySpec) -> DataFrame:
    """The answer, by the view that the family is routed to."""
    admit(archive.contract, spec)
    return over_cells(archive.view(layouts.route(list(archive.views), spec.family).name), archive.contract, spec)


def from_events(events: DataFrame, contract: Contract, spec: QuerySpec, order: bool = True) -> DataFrame:
    """The answer by scanning raw events; an independent path."""
    measures = wanted(admit(contract, spec), spec)
    rows = events.where(state.selected(spec, F.col("timestamp_ns"), state.dimension))
    return _finish(state.cells(rows, contract.bucket_ns, spec.group_by, measures), spec, measures, order)


def batch(archive, specs: list[QuerySpec]) -> DataFrame:
    """Many answers as one table: query, bucket_ns, group_1.. in the order of the request, and a column for each measure.

    Each view is scanned once. Requests that read the same cells and group alike share a slot; a cell goes
    to every slot that selects it, without the dimensions that the slot doesn't group by, and one aggregation, which
    combines map-side, answers all slots. Measures not asked for are null.
    """
    of_view: dict[str, dict[tuple, list[int]]] = {}
    for i, s in enumerate(specs):
        admit(archive.contract, s)
        slot = (s.start_ns, s.end_ns, json.dumps(s.filters, sort_keys=True), s.group_by)
        of_view.setdefault(layouts.route(list(archive.views), s.family).name, {}).setdefault(slot, []).append(i)
    parts = [_slots(archive, name, specs, list(slots.values())) for name, slots in of_view.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _slots(archive, view: str, specs: list[QuerySpec], slots: list[list[int]]) -> DataFrame:
    """The answers of requests on one view; ``slots`` lists requests that differ in family and measures only."""
    first = [specs[numbers[0]] for numbers in slots]
    asked = {i: wanted(archive.contract.family(specs[i].family), specs[i]) for numbers in slots for i in numbers}
    measures = list({m.name: m for ms in asked.values() for m in ms}.values())
    slot, number = F.col("__slot"), F.col("query")
    picks = F.filter(F.array(*[F.when(state.selected(s, F.col(state.BUCKET)), F.lit(k)) for k, s in enumerate(first)]), lambda x: x.isNotNull())
    cells = archive.view(view).where((F.col(state.BUCKET) >= min(s.start_ns for s in first)) & (F.col(state.BUCKET) < max(s.end_ns for s in first)))
    cells = cells.withColumn("__slot", F.explode(picks))
    dims = list(dict.fromkeys(d for s in first for d in s.group_by))
    masked = [F.when(slot.isin([k for k, s in enumerate(first) if d in s.group_by]), state.quoted(d)).alias(d) for d in dims]
    merged = cells.groupBy("__slot", state.BUCKET, *masked).agg(*[c for m in measures for c in state.merge(m)])
    groups = []
    for place in range(max(len(s.group_by) for s in first)):
        at: dict[str, list[int]] = {}
        for k, s in enumerate(first):
            if place < len(s.group_by):
                at.setdefault(s.group_by[place], []).append(k)
        value = F.lit(None).cast("string")
        for d, ks in at.items():
            value = F.when(slot.isin(ks), state.quoted(d)).otherwise(value)
        groups.append(value.alias(f"group_{place + 1}"))
    requests = F.element_at(F.array(*[F.array(*[F.lit(i) for i in numbers]) for numbers in slots]), slot + 1)
    rows = merged.select(F.explode(requests).alias("query"), state.BUCKET, *groups, *[state.answer(m) for m in measures])
    picked = [F.when(number.isin([i for i, ms in asked.items() if m in ms]), state.quoted(m.name)).alias(m.name) for m in measures]
    return rows.select("query", state.BUCKET, *[F.col(f"group_{g + 1}") for g in range(len(groups))], *picked)


def envelope(archive, spec: QuerySpec) -> dict:
    """The answer as a versioned document, values tagged by kind. Rows come to the driver."""
    measures = wanted(admit(archive.contract, spec), spec)
    kind = lambda m: "histogram" if m.op == "histogram" else "count" if m.op in ("count", "count_present") else "integer"
    rows = [
        {"bucket_ns": r[0], "dimensions": {d: r[d] for d in spec.group_by}, "measures": {m.name: {"type": kind(m), "value": r[m.name]} for m in measures}}
        for r in from_views(archive, spec).toLocalIterator()
    ]
    head = json.loads(spec.to_json()) | {"measures": [m.name for m in measures]}
    return {"schema_version": 1, "archive_hash": archive.manifest["archive_hash"], "contract_hash": archive.manifest["contract_hash"], "exactness": "exact", **head, "rows": rows}


def rows_hash(document: dict) -> str:
    return hashlib.sha256(json.dumps(document["rows"], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
