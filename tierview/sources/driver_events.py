"""Canonical events from the ``events`` test table, and the same mapping as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import FIELDS


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    fifth, error = F.col("event_id") % 5 == 0, F.col("event_type") == "error"
    pad = lambda prefix, c, n: F.concat(F.lit(prefix), F.lpad(c.cast("string"), n, "0"))
    columns = {
        "schema_version": F.lit(1),
        "timestamp_ns": F.unix_micros(F.col("ts").cast("timestamp")) * F.lit(1000).cast("long"),
        "event_id": pad("evt-", F.col("event_id"), 12),
        "trace_id": F.concat(F.lit("trace-"), F.expr("event_id div 8").cast("string")),
        "span_id": F.lit(None).cast("string"),
        "parent_span_id": F.lit(None).cast("string"),
        "service": pad("svc-", F.pmod("user_id", F.lit(16)), 3),
        "operation": pad("op-", F.col("user_id"), 6),
        "event_type": F.col("event_type"),
        "severity": F.when(error, "ERROR").otherwise("INFO"),
        "status": F.when(error, "ERROR").otherwise("OK"),
        "error_code": F.when(error, pad("E", k, 5)),
        "model": F.when(fifth, F.concat(F.lit("model-"), (F.col("event_id") % 8).cast("string"))),
        "duration_ns": F.round(F.col("value") * 100).cast("long") * F.lit(10_000).cast("long"),
        "bytes_in": F.pmod(F.col("event_id") * 7919, F.lit(65536)),
        "bytes_out": F.when(F.col("event_id") % 10 != 3, F.pmod(F.col("event_id") * 104729, F.lit(262144))),
        "tokens_in": F.when(fifth, k),
        "tokens_out": F.when(fifth, k * 2),
        "attributes": F.create_map(F.lit("region"), F.concat(F.lit("region-"), F.pmod("user_id", F.lit(4)).cast("string")), F.lit("k"), k.cast("string")),
        "body": F.col("props"),
    }
    return e.select(*[columns[f].alias(f) for f in FIELDS])


SQL = """SELECT epoch_us(ts) * 1000 AS timestamp_ns, 'evt-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id,
  'trace-' || CAST(event_id // 8 AS VARCHAR) AS trace_id, 'svc-' || lpad(CAST(user_id % 16 AS VARCHAR), 3, '0') AS service,
  'op-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS operation, event_type,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
  CASE WHEN event_type = 'error' THEN 'E' || lpad(json_extract_string(props, '$.k'), 5, '0') END AS error_code,
  CASE WHEN event_id % 5 = 0 THEN 'model-' || CAST(event_id % 8 AS VARCHAR) END AS model,
  CAST(round(value * 100) AS BIGINT) * 10000 AS duration_ns, (event_id * 7919) % 65536 AS bytes_in,
  CASE WHEN event_id % 10 <> 3 THEN (event_id * 104729) % 262144 END AS bytes_out,
  CASE WHEN event_id % 5 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens_in,
  CASE WHEN event_id % 5 = 0 THEN 2 * CAST(json_extract_string(props, '$.k') AS BIGINT) END AS tokens_out,
  'region-' || CAST(user_id % 4 AS VARCHAR) AS region FROM events"""
