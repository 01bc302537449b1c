"""Public log formats as canonical events. Malformed lines are kept as ``unparsed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.values import I64_MAX, I64_MIN
from .canonical import FIELDS

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def indexed(lines: DataFrame) -> DataFrame:
    """Adds ``index``, the line's number from 0, from counts of partitions (one row a partition is gathered, no line is shuffled)."""
    placed = lines.withColumn("__i", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("__i", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [0], 0
    for p in range(max(counts, default=-1)):
        total += counts.get(p, 0)
        before.append(total)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (part + 1).cast("int"))
    return placed.withColumn("index", start + F.col("__i").bitwiseAND((1 << 33) - 1)).drop("__i")


def _words(c: Column) -> Column:
    """Split at Unicode white space, none at the ends."""
    return F.split(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")


def _at(words: Column, i: int) -> Column:
    return F.try_element_at(words, F.lit(i + 1))


def _event(lines: DataFrame, service: str, parsed: Column, timestamp: Column, operation: Column, severity: Column, attributes: Column) -> DataFrame:
    error = F.col("severity").isin("ERROR", "FATAL")
    out = lines.withColumns({"__parsed": parsed, "timestamp_ns": timestamp, "operation": operation, "severity": severity, "attributes": attributes})
    columns: dict[str, Column] = {f: F.lit(None).cast("long" if f.startswith(("duration", "bytes", "tokens")) else "string") for f in FIELDS}
    columns |= {c: F.col(c) for c in ("timestamp_ns", "operation", "severity", "attributes")}
    columns |= {
        "schema_version": F.lit(1),
        "event_id": F.format_string(f"{service}-%012d", F.col("index")),
        "service": F.lit(service),
        "event_type": F.when(F.col("__parsed"), "log.record").otherwise("unparsed"),
        "status": F.when(error, "ERROR").otherwise("OK"),
        "error_code": F.when(error, "LOG_ALERT"),
        "body": F.to_json(F.struct(F.col("value").alias("raw_line"))),
    }
    return out.select(*[columns[f].alias(f) for f in FIELDS], (~F.col("__parsed")).alias("warning"))


def zookeeper(lines: DataFrame) -> DataFrame:
    """``time - level [context:logger@line] - message`` lines with (value, index) as events and ``warning``."""
    parts = F.split("value", " - ", 5)
    head, context = parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    local = F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    zoned = F.when(head.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(head))
    timestamp = F.coalesce(F.unix_micros(F.coalesce(local, zoned)) * F.lit(1000).cast("long"), F.col("index"))
    level = F.try_element_at(F.filter(_words(context), lambda w: w.isin(*LEVELS)), F.lit(1))
    logger = F.when(F.instr(context, ":") > 0, F.regexp_extract(context, r"(?s)^[^:]*:([^@]*)", 1)).otherwise("zookeeper")
    return _event(lines, "zookeeper", F.size(parts) >= 2, timestamp, logger, F.coalesce(level, F.lit("UNKNOWN")), F.create_map().cast("map<string,string>"))


def bgl(lines: DataFrame) -> DataFrame:
    """Lines of nine fields or more (alert, seconds, ..., node, ..., facility, component) with (value, index) as events and ``warning``."""
    w = F.filter(_words(F.col("value")), lambda x: x != "")
    seconds = F.when(_at(w, 1).rlike(r"^[+-]?[0-9]+$"), _at(w, 1).try_cast("decimal(38,0)")).cast("decimal(38,0)")
    fits = (seconds >= I64_MIN) & (seconds <= I64_MAX)
    ns = F.least(F.greatest(seconds.cast("decimal(28,0)") * F.lit(10**9).cast("decimal(10,0)"), F.lit(I64_MIN).cast("decimal(38,0)")), F.lit(I64_MAX).cast("decimal(38,0)"))
    timestamp = F.coalesce(F.when(fits, ns.cast("long")), F.col("index"))
    alert = F.coalesce(_at(w, 0) != "-", F.lit(False))
    attributes = F.create_map(F.lit("node"), _at(w, 3), F.lit("facility"), _at(w, 6))
    return _event(lines, "bgl", F.size(w) >= 9, timestamp, F.coalesce(_at(w, 7), F.lit("bgl")), F.when(alert, "ERROR").otherwise("INFO"), attributes)


ADAPTERS = {"zookeeper": zookeeper, "bgl": bgl}


def normalize(lines: DataFrame, adapter: str) -> DataFrame:
    """Events of log lines; raises if there are none or more than one in a thousand is malformed."""
    if adapter not in ADAPTERS:
        raise InputError(f"no adapter {adapter!r}; there are {', '.join(ADAPTERS)}")
    found = ADAPTERS[adapter](indexed(lines))
    n = found.agg(F.count("*").alias("n"), F.count_if("warning").alias("bad")).first()
    if not n["n"]:
        raise InputError("the input is empty")
    if n["bad"] * 1000 > n["n"]:
        raise InputError(f"{n['bad']} of {n['n']} lines are malformed")
    return found.drop("warning")
