"""Which physical views answer which families."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ContractError
from .contract import Contract, Measure

MOST_UNIFIED = 8


@dataclass(frozen=True)
class View:
    """One cell table: its dimensions in order, its measures, the families that it answers."""

    name: str
    dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]
    families: tuple[str, ...]


def _merge(into: list[Measure], more: tuple[Measure, ...]) -> None:
    for m in more:
        same = next((x for x in into if (x.field, x.op) == (m.field, m.op)), None)
        if same is None:
            into.append(m)
        elif same.bounds != m.bounds:
            raise ContractError(f"incompatible bounds for {m.name} in one view")


def separate(contract: Contract) -> list[View]:
    """A view for each distinct ordered list of dimensions."""
    found: dict[tuple[str, ...], tuple[list[Measure], list[str]]] = {}
    for f in contract.families:
        measures, names = found.setdefault(f.dimensions, ([], []))
        _merge(measures, f.measures)
        names.append(f.name)
    return [View(f"view-{i:02d}", d, tuple(m), tuple(n)) for i, (d, (m, n)) in enumerate(found.items())]


def unified(contract: Contract) -> list[View]:
    """One view over the sorted union of all dimensions."""
    dimensions = tuple(sorted({d for f in contract.families for d in f.dimensions}))
    if len(dimensions) > MOST_UNIFIED:
        raise ContractError(f"a unified view has {MOST_UNIFIED} dimensions at most")
    measures: list[Measure] = []
    for f in contract.families:
        _merge(measures, f.measures)
    return [View("view-00", dimensions, tuple(measures), tuple(f.name for f in contract.families))]


def unified_legal(contract: Contract) -> bool:
    try:
        unified(contract)
    except ContractError:
        return False
    return True


def plan(contract: Contract, layout: str) -> list[View]:
    if layout not in ("separate", "unified"):
        raise ContractError(f"unknown layout {layout!r}")
    return separate(contract) if layout == "separate" else unified(contract)


def route(views: list[View], family: str) -> View:
    return next(v for v in views if family in v.families)
