"""Requests, and what makes one legal. Nothing here touches Spark."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..errors import QueryRejected
from .contract import Contract, Family, Measure


@dataclass(frozen=True)
class QuerySpec:
    family: str
    start_ns: int
    end_ns: int
    filters: dict[str, list[str | None]] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps({"family": self.family, "start_ns": self.start_ns, "end_ns": self.end_ns, "filters": dict(sorted(self.filters.items())), "group_by": list(self.group_by), "measures": list(self.measures)}, separators=(",", ":"))

    @classmethod
    def from_json(cls, line: str) -> QuerySpec:
        try:
            d = json.loads(line)
            allowed = {"family", "start_ns", "end_ns", "filters", "group_by", "measures"}
            if set(d) - allowed:
                raise ValueError(f"unknown key {sorted(set(d) - allowed)[0]}")
            return cls(d["family"], int(d["start_ns"]), int(d["end_ns"]), dict(d.get("filters", {})), tuple(d.get("group_by", ())), tuple(d.get("measures", ())))
        except (ValueError, KeyError, TypeError) as e:
            raise QueryRejected(f"not a request: {e}") from e


def read_workload(path: str) -> list[QuerySpec]:
    with open(path, encoding="utf-8") as f:
        return [QuerySpec.from_json(line) for line in f if line.strip()]


def admit(contract: Contract, spec: QuerySpec) -> Family:
    """The family that answers ``spec``; raises for anything that it doesn't preserve."""
    family = contract.family(spec.family)
    if family is None:
        raise QueryRejected(f"no family {spec.family!r}")
    if spec.start_ns >= spec.end_ns:
        raise QueryRejected("the interval must increase")
    width = contract.bucket_ns
    if spec.start_ns % width or spec.end_ns % width:
        raise QueryRejected("the interval isn't aligned with buckets")
    if len(set(spec.group_by)) != len(spec.group_by):
        raise QueryRejected("a grouping twice")
    for d in (*spec.group_by, *spec.filters):
        if d not in family.dimensions:
            raise QueryRejected(f"{spec.family} has no dimension {d!r}")
    for d, values in spec.filters.items():
        if not values or not all(v is None or isinstance(v, str) for v in values):
            raise QueryRejected(f"no values to filter {d} by")
    if len(set(spec.measures)) != len(spec.measures):
        raise QueryRejected("a measure twice")
    names = {m.name for m in family.measures}
    for m in spec.measures:
        if m not in names:
            raise QueryRejected(f"{spec.family} has no measure {m!r}")
    return family


def wanted(family: Family, spec: QuerySpec) -> list[Measure]:
    """Measures asked for, in the contract's order; none named means all."""
    return [m for m in family.measures if not spec.measures or m.name in spec.measures]
