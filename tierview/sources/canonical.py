"""Canonical events: schema, strict NDJSON, writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..plans.contract import MEASURES

# The event model.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
STATUSES = ("OK", "ERROR", "UNSET")
FIELDS = (
    "schema_version", "timestamp_ns", "event_id", "trace_id", "span_id", "parent_span_id", "service", "operation", "event_type", "severity",
    "status", "error_code", "model", "duration_ns", "bytes_in", "bytes_out", "tokens_in", "tokens_out", "attributes", "body",
)
REQUIRED = ("schema_version", "timestamp_ns", "event_id", "service", "event_type", "severity", "status")
_KINDS: dict[str, T.DataType] = {"schema_version": T.IntegerType(), "timestamp_ns": T.LongType(), **{m: T.LongType() for m in MEASURES}, "attributes": T.MapType(T.StringType(), T.StringType())}
SCHEMA = T.StructType([T.StructField(f, _KINDS.get(f, T.StringType())) for f in FIELDS])
_TEXTS = [f for f in FIELDS if f not in _KINDS and f != "body"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text (plain, .gz or .zst), split at newlines only, one carriage return before them dropped."""
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def scan(lines: DataFrame) -> DataFrame:
    """Events of JSON lines, and ``problem``: why a line isn't an event, else null.

    What a permissive parser would let pass is looked for: duplicate and unknown keys, numbers in
    text fields, fractions and strings in number fields, attributes that are neither text nor null.
    """
    # As variant a document keeps each value's own type; duplicate keys make it null.
    v = F.try_parse_json("value")
    # A generator, because the optimizer would put parsers in place of their columns wherever a filter on ``problem`` names them.
    typed = lines.select(F.inline(F.array(F.struct("value", v.alias("__v"), F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("e"), F.json_object_keys("value").alias("__keys")))))
    kind = F.schema_of_variant
    get = lambda name: F.try_variant_get("__v", f"$.{name}", "variant")
    is_kind = lambda name, *kinds: F.coalesce(kind(get(name)).isin(*kinds, "VOID"), F.lit(True))
    unknown = F.array_except("__keys", F.array(*[F.lit(f) for f in FIELDS]))
    whole = lambda name: is_kind(name, "BIGINT") & (F.col(f"e.{name}").isNotNull() | get(name).isNull() | (kind(get(name)) == "VOID"))
    attributes = F.from_json(F.try_variant_get("__v", "$.attributes", "string"), T.MapType(T.StringType(), T.StringType()))
    values = F.map_values(F.try_variant_get("__v", "$.attributes", "map<string,variant>"))
    odd_attributes = F.coalesce(F.exists(values, lambda x: ~F.coalesce(kind(x), F.lit("VOID")).isin("STRING", "VOID")), F.lit(False))
    problem = (
        F.when(F.col("__v").isNull(), "not a JSON document, or a key twice")
        .when(~kind("__v").startswith("OBJECT"), "not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), unknown[0]))
    )
    for name in _TEXTS:
        problem = problem.when(~is_kind(name, "STRING"), f"{name} must be text")
    for name in ("schema_version", "timestamp_ns", *MEASURES):
        problem = problem.when(~whole(name), f"{name} must be a 64-bit integer")
    problem = problem.when(~F.coalesce(kind(get("attributes")).startswith("OBJECT"), F.lit(True)) | odd_attributes, "attributes must be an object of text or null")
    out = typed.select("value", problem.alias("__p"), *[(F.coalesce(F.col("e.attributes"), attributes, F.create_map().cast("map<string,string>")) if f == "attributes" else F.col(f"e.{f}")).alias(f) for f in FIELDS])
    return out.withColumn("problem", F.coalesce("__p", violation())).drop("__p")


def violation() -> Column:
    """Why a typed event breaks the model, else null."""
    out = F.when(F.lit(False), "")
    for name in REQUIRED:
        out = out.when(F.col(name).isNull(), f"{name} is missing")
    out = out.when(F.col("schema_version") != 1, "schema_version must be 1")
    for name in ("event_id", "service", "event_type"):
        out = out.when(F.col(name) == "", f"{name} must not be empty")
    return out.when(~F.col("severity").isin(*SEVERITIES), "unknown severity").when(~F.col("status").isin(*STATUSES), "unknown status")


def duplicate_ids(events: DataFrame) -> DataFrame:
    return events.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Valid events of an NDJSON source; raises at the first kind of fault."""
    found = scan(read_lines(spark, path))
    check(found)
    return found.drop("value", "problem")


def check(scanned: DataFrame) -> None:
    if bad := scanned.where("problem is not null").select("problem", F.substring("value", 1, 200).alias("line")).first():
        raise InputError(f"{bad['problem']}: {bad['line']}")
    check_unique(scanned)


def check_unique(events: DataFrame) -> None:
    if twice := duplicate_ids(events).first():
        raise InputError(f"event_id {twice['event_id']!r} occurs {twice['n']} times")


def canonical_json() -> Column:
    """An event as its canonical line: fields in order, absent ones left out, attributes sorted, body last."""
    body = F.coalesce("body", F.lit("null"))
    keys = F.array_sort(F.map_keys("attributes"))
    pairs = F.transform(keys, lambda k: F.concat(_text(k), F.lit(":"), F.coalesce(_text(F.try_element_at("attributes", k)), F.lit("null"))))
    parts = []
    for f in FIELDS[:-2]:
        value = F.col(f).cast("string") if f in _KINDS else _text(F.col(f))
        parts.append(F.concat(F.lit(f'"{f}":'), value))
    parts += [F.concat(F.lit('"attributes":{'), F.coalesce(F.array_join(pairs, ","), F.lit("")), F.lit("}")), F.concat(F.lit('"body":'), body)]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def _text(c: Column) -> Column:
    """A JSON string literal, or null."""
    return F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def write_jsonl(events: DataFrame, path: str, compression: str = "none") -> None:
    events.select(canonical_json().alias("value")).write.option("compression", compression).text(path)


def content_hash(events: DataFrame) -> str:
    """A digest of all canonical lines that doesn't depend on order: sums of parts of each line's SHA-256."""
    h = F.sha2(canonical_json(), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    row = events.select(h.alias("h"), *events.columns).agg(F.count("*").alias("n"), *parts).first()
    return "sha256-sum:" + hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()


def source_stats(events: DataFrame, error: Column) -> DataFrame:
    """One row: events, bounds and errors."""
    return events.agg(F.count("*").alias("event_count"), F.min("timestamp_ns").alias("min_timestamp_ns"), F.max("timestamp_ns").alias("max_timestamp_ns"), F.count_if(error).alias("error_count"))


def infer_json(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Inferred JSON with missing ``columns`` (name: type) patched in as nulls."""
    df = spark.read.json(path)
    return df.withColumns({c: F.lit(None).cast(k) for c, k in columns.items() if c not in df.columns})
