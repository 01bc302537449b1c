"""Contracts: what must stay answerable."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field

from ..errors import ContractError
from ..functions.values import DAY_NS, I64_MAX, I64_MIN, UNIT_NS, duration_ns, measure_name

# Names of the event model.
DIMENSIONS = ("service", "operation", "event_type", "severity", "status", "error_code", "model", "trace_id", "span_id", "parent_span_id")
MEASURES = ("duration_ns", "bytes_in", "bytes_out", "tokens_in", "tokens_out")
OPERATIONS = ("count", "count_present", "sum", "min", "max", "histogram")
ATTRIBUTE = "attributes."
MOST_DIMENSIONS = 6


@dataclass(frozen=True)
class Measure:
    field: str
    op: str
    bounds: tuple[int, ...] | None = None

    @property
    def name(self) -> str:
        return measure_name(self.field, self.op)


@dataclass(frozen=True)
class Family:
    name: str
    dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]


@dataclass(frozen=True)
class Retention:
    recent: str = "24h"
    error_severities: tuple[str, ...] = ()
    error_statuses: tuple[str, ...] = ()

    def recent_ns(self) -> int | None:
        """How far back non-errors are kept; None for all of them."""
        if self.recent == "all":
            return None
        return 0 if self.recent == "0" else duration_ns(self.recent)


@dataclass(frozen=True)
class Contract:
    version: int
    name: str
    time_bucket: str
    retention: Retention
    families: tuple[Family, ...]
    source: str = field(default="", compare=False)

    @property
    def bucket_ns(self) -> int:
        return duration_ns(self.time_bucket)

    def family(self, name: str) -> Family | None:
        return next((f for f in self.families if f.name == name), None)

    def digest(self) -> str:
        return "sha256:" + hashlib.sha256(self.source.encode()).hexdigest()


def _keys(table: dict, allowed: set[str], needed: set[str], where: str) -> dict:
    if not isinstance(table, dict):
        raise ContractError(f"{where} must be a table")
    if extra := set(table) - allowed:
        raise ContractError(f"unknown key in {where}: {sorted(extra)[0]}")
    if missing := needed - set(table):
        raise ContractError(f"missing key in {where}: {sorted(missing)[0]}")
    return table


def _strings(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ContractError(f"{where} must be a list of strings")
    return tuple(value)


def parse(text: str) -> Contract:
    """A validated contract from TOML."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ContractError(f"not TOML: {e}") from e
    _keys(doc, {"version", "name", "time_bucket", "retention", "families"}, {"version", "name", "time_bucket", "retention", "families"}, "the contract")
    r = _keys(doc["retention"], {"recent", "error_severities", "error_statuses"}, {"recent", "error_severities", "error_statuses"}, "retention")
    families = []
    if not isinstance(doc["families"], list):
        raise ContractError("families must be a list")
    for f in doc["families"]:
        _keys(f, {"name", "dimensions", "measures"}, {"name", "dimensions", "measures"}, "a family")
        measures = []
        for m in f["measures"]:
            _keys(m, {"field", "op", "bounds"}, {"field", "op"}, "a measure")
            bounds = m.get("bounds", [])
            if not isinstance(bounds, list):
                raise ContractError("bounds must be a list")
            measures.append(Measure(m["field"], m["op"], tuple(bounds) if bounds or m["op"] == "histogram" else None))
        families.append(Family(f["name"], _strings(f["dimensions"], "dimensions"), tuple(measures)))
    retention = Retention(r["recent"], _strings(r["error_severities"], "error_severities"), _strings(r["error_statuses"], "error_statuses"))
    return validate(Contract(doc["version"], doc["name"], doc["time_bucket"], retention, tuple(families), text))


def load(path: str) -> Contract:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def known_dimension(name: str) -> bool:
    return name in DIMENSIONS or name.startswith(ATTRIBUTE)


def validate(c: Contract) -> Contract:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ContractError(what)

    need(c.version == 1 and c.version is not True, "version must be 1")
    need(isinstance(c.name, str) and bool(c.name), "name must not be empty")
    need(bool(c.families), "at least one family is needed")
    width = c.bucket_ns
    need(UNIT_NS["s"] <= width <= DAY_NS and DAY_NS % width == 0, "time_bucket must be 1s to 1d and divide a day")
    c.retention.recent_ns()
    names = [f.name for f in c.families]
    need(len(set(names)) == len(names), "family names must differ")
    for f in c.families:
        need(isinstance(f.name, str) and bool(f.name), "a family needs a name")
        need(1 <= len(f.dimensions) <= MOST_DIMENSIONS, f"{f.name}: 1 to {MOST_DIMENSIONS} dimensions")
        need(len(set(f.dimensions)) == len(f.dimensions), f"{f.name}: a dimension twice")
        for d in f.dimensions:
            need(known_dimension(d), f"{f.name}: unknown dimension {d}")
        need(bool(f.measures), f"{f.name}: at least one measure")
        pairs = [(m.field, m.op) for m in f.measures]
        need(len(set(pairs)) == len(pairs), f"{f.name}: a measure twice")
        for m in f.measures:
            need(m.op in OPERATIONS, f"{f.name}: unknown operation {m.op}")
            need((m.field == "*") if m.op == "count" else (m.field in MEASURES), f"{f.name}: {m.op} can't be of {m.field}")
            need((m.bounds is not None) == (m.op == "histogram"), f"{f.name}: bounds belong to histograms, which may have none")
            for b in m.bounds or ():
                need(isinstance(b, int) and not isinstance(b, bool) and I64_MIN <= b <= I64_MAX, f"{f.name}: a bound isn't a 64-bit integer")
            need(all(a < b for a, b in zip(m.bounds or (), (m.bounds or ())[1:])), f"{f.name}: bounds must rise")
    return c


# The standard contract.
TELEMETRY = """version = 1
name = "telemetry-v1"
time_bucket = "{bucket}"

[retention]
recent = "{recent}"
error_severities = ["ERROR", "FATAL"]
error_statuses = ["ERROR"]

[[families]]
name = "event-volume"
dimensions = ["service", "event_type", "severity", "status"]
measures = [{{ field = "*", op = "count" }}]

[[families]]
name = "latency"
dimensions = ["service", "operation", "status"]
measures = [
  {{ field = "duration_ns", op = "count_present" }}, {{ field = "duration_ns", op = "sum" }},
  {{ field = "duration_ns", op = "min" }}, {{ field = "duration_ns", op = "max" }},
  {{ field = "duration_ns", op = "histogram", bounds = [1000000, 5000000, 10000000, 50000000, 100000000, 500000000, 1000000000] }},
]

[[families]]
name = "traffic"
dimensions = ["service", "operation", "status"]
measures = [{{ field = "bytes_in", op = "sum" }}, {{ field = "bytes_out", op = "sum" }}]

[[families]]
name = "model-usage"
dimensions = ["service", "operation", "model", "status"]
measures = [{{ field = "tokens_in", op = "sum" }}, {{ field = "tokens_out", op = "sum" }}]

[[families]]
name = "error-volume"
dimensions = ["service", "operation", "error_code", "severity"]
measures = [{{ field = "*", op = "count" }}]
"""


def telemetry(bucket: str = "1m", recent: str = "24h") -> Contract:
    """The standard contract over canonical events."""
    return parse(TELEMETRY.format(bucket=bucket, recent=recent))
