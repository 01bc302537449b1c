"""Synthetic canonical events: each event is a function of its number and the seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ContractError
from .canonical import FIELDS, canonical_json

# The period that events fall in.
START_NS, SPAN_NS, HALF_HOUR_NS = 1_784_064_000_000_000_000, 30 * 86_400 * 10**9, 1800 * 10**9


@dataclass(frozen=True)
class Scenario:
    services: int = 16
    operations: int = 256
    errors_per_10k: int = 100
    skewed: bool = True
    burst: bool = False
    hex_body: bool = False
    shuffled: bool = False


SCENARIOS = {
    "standard": Scenario(),
    "low-cardinality": Scenario(services=4, operations=16, errors_per_10k=10),
    "high-cardinality": Scenario(services=64, operations=100_000, skewed=False),
    "high-entropy-body": Scenario(hex_body=True),
    "error-burst": Scenario(burst=True),
    "out-of-order": Scenario(shuffled=True),
}
WINDOW = 10_000


def generate(spark: SparkSession, scenario: str, events: int, seed: int, partitions: int | None = None) -> DataFrame:
    """Canonical events of a scenario."""
    if scenario not in SCENARIOS:
        raise ContractError(f"no scenario {scenario!r}; there are {', '.join(SCENARIOS)}")
    s, i = SCENARIOS[scenario], F.col("id")
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(n).cast("long"))
    offset = ((i.cast("decimal(19,0)") * F.lit(SPAN_NS).cast("decimal(19,0)")) / F.lit(max(events, 1)).cast("decimal(19,0)")).cast("decimal(38,6)")
    time = F.lit(START_NS).cast("long") + F.floor(offset).cast("long")
    often = draw("error", 10_000) < s.errors_per_10k
    error = F.when(F.pmod(F.floor((time - START_NS) / HALF_HOUR_NS), F.lit(120)) == 0, draw("burst", 4) == 0).otherwise(often) if s.burst else often
    operation = F.least(draw("a", s.operations), draw("b", s.operations)) if s.skewed else draw("a", s.operations)
    pad = lambda prefix, c, n: F.concat(F.lit(prefix), F.lpad(c.cast("string"), n, "0"))
    body: Column = F.concat(F.lit('{"message":"template-'), draw("template", 64).cast("string"), F.lit(' completed"}'))
    if s.hex_body:
        body = F.concat(F.lit('{"random_hex":"'), *[F.sha2(F.concat_ws("/", F.lit(seed), F.lit(k), i), 256) for k in range(16)], F.lit('"}'))
    fifth, none = i % 5 == 0, F.lit(None).cast("string")
    base = spark.range(0, events, 1, partitions) if partitions else spark.range(events)
    base = base.withColumn("__error", error)
    bad = F.col("__error")
    columns = {
        "schema_version": F.lit(1), "timestamp_ns": time, "event_id": pad("evt-", i, 12), "trace_id": pad("trace-", F.expr("id div 8"), 10),
        "span_id": pad("span-", i, 12), "parent_span_id": F.when(i % 8 != 0, pad("span-", i - 1, 12)).otherwise(none),
        "service": pad("service-", draw("service", s.services), 3), "operation": pad("operation-", operation, 6),
        "event_type": F.when(bad, "request.failed").otherwise("request.completed"), "severity": F.when(bad, "ERROR").otherwise("INFO"),
        "status": F.when(bad, "ERROR").otherwise("OK"), "error_code": F.when(bad, pad("E", draw("code", 10_000), 5)),
        "model": F.when(fifth, F.concat(F.lit("model-"), draw("model", 8).cast("string"))), "duration_ns": draw("duration", 1_500_000_000) + 500_000,
        "bytes_in": draw("in", 65_536 - 64) + 64, "bytes_out": draw("out", 262_144 - 64) + 64,
        "tokens_in": F.when(fifth, draw("tokens_in", 8_191) + 1), "tokens_out": F.when(fifth, draw("tokens_out", 4_095) + 1),
        "attributes": F.create_map(F.lit("host"), F.concat(F.lit("host-"), draw("host", 128).cast("string")), F.lit("region"), F.concat(F.lit("region-"), draw("region", 4).cast("string"))),
        "body": body,
    }
    if s.shuffled:
        base = base.orderBy(F.expr(f"id div {WINDOW}"), draw("order", 1 << 62))
    return base.select(*[columns[f].alias(f) for f in FIELDS])


def capped(events: DataFrame, most_bytes: int, key: str = "event_id", block: int = WINDOW) -> DataFrame:
    """The first events by ``key`` whose canonical lines fit in ``most_bytes``, newlines counted; sums run over blocks of events."""
    sized = events.withColumn("__n", F.octet_length(canonical_json()) + 1).withColumn("__b", F.floor(F.regexp_extract(key, r"(\d+)$", 1).cast("long") / block))
    sums = sized.groupBy("__b").agg(F.sum("__n").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = F.sum("__n").over(Window.partitionBy("__b").orderBy(key))
    return sized.join(sums.select("__b", "__before"), "__b").where((F.col("__before") < most_bytes)).withColumn("__r", running + F.col("__before")).where(F.col("__r") <= most_bytes).drop("__n", "__b", "__before", "__r")


def metadata(events: DataFrame) -> dict:
    """Count, bytes, bounds, errors and cardinalities, in one pass."""
    names = ("service", "operation", "model", "error_code")
    row = events.agg(
        F.count("*").alias("event_count"), F.sum(F.octet_length(canonical_json()) + 1).alias("canonical_bytes"), F.min("timestamp_ns").alias("min_timestamp_ns"),
        F.max("timestamp_ns").alias("max_timestamp_ns"), F.count_if(F.col("status") == "ERROR").alias("error_count"), *[F.countDistinct(n).alias(f"cardinality_{n}") for n in names],
    ).first()
    return row.asDict()
