"""The engine's own queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, query, verify, workload
from .archive import _dealt
from .errors import QueryRejected
from .files import Store, shared_dir
from .functions.values import DAY_NS, bucket_start
from .operators import dictionary, state, tiers
from .plans import contract as contracts
from .plans import layout as layouts
from .plans.admission import QuerySpec, admit
from .plans.contract import Contract, Measure
from .sources import adapters, generator
from .sources.canonical import duplicate_ids, scan, source_stats, violation
from .sources.driver_events import SQL as EVENTS
from .sources.driver_events import canonical_events

MINUTE, DAY = contracts.telemetry(), contracts.telemetry(bucket="1d")
BUCKET_NS = MINUTE.bucket_ns
#: A week of the test table's period, 2024-01-08 to 2024-01-15.
WEEK = (1_704_672_000_000_000_000, 1_705_276_800_000_000_000)
EVERYTHING = (1_704_067_200_000_000_000, 1_706_745_600_000_000_000)
RECENT_NS = DAY_NS
HISTOGRAM = next(m for m in MINUTE.family("latency").measures if m.op == "histogram")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_views: dict[tuple, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH ev AS ({EVENTS}) {sql}"
        return f

    return add


def view(spark: SparkSession, sf_dir: str, contract: Contract, family: str, layout: str = "separate") -> DataFrame:
    """Cells that answer a family, written once for each source and read as any archive's view."""
    v = layouts.route(layouts.plan(contract, layout), family)
    key = (spark.sparkContext.applicationId, tuple(sorted(spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles())), contract.digest(), layout, v.name)
    if key not in _views:
        path = f"{shared_dir(spark)}/views-{uuid.uuid4().hex}"
        cells = state.cells(canonical_events(spark, sf_dir), contract.bucket_ns, v.dimensions, v.measures)
        _dealt(cells, state.BUCKET, list(v.dimensions), 8).write.option("compression", "zstd").parquet(path)
        _views[key] = path
    return spark.read.parquet(_views[key])


def flat(df: DataFrame) -> DataFrame:
    """Bins as columns hist_0.. and names that SQL shares."""
    out: list[Column] = []
    for c, kind in df.dtypes:
        if kind.startswith("array"):
            out += [F.col(f"`{c}`")[i].alias(f"hist_{i}") for i in range(len(HISTOGRAM.bounds) + 1)]
        else:
            out.append(F.col(f"`{c}`").alias(c.replace(":", "_").replace(".", "_")))
    return df.select(*out)


def _bucket_sql(width: int, column: str = "timestamp_ns") -> str:
    return f"{column} - ((({column} % {width}) + {width}) % {width})"


def _measure_sql(m: Measure) -> list[str]:
    if m.op == "count":
        return ["count(*) AS count"]
    if m.op == "count_present":
        return [f"count({m.field}) AS {m.field}_count_present"]
    if m.op == "histogram":
        edges = [None, *m.bounds, None]
        cond = [" AND ".join([f"{m.field} IS NOT NULL"] + [f"{m.field} >= {lo}"] * (lo is not None) + [f"{m.field} < {hi}"] * (hi is not None)) for lo, hi in zip(edges, edges[1:])]
        return [f"count(*) FILTER (WHERE {c}) AS hist_{i}" for i, c in enumerate(cond)]
    return [f"CAST({m.op}({m.field}) AS BIGINT) AS {m.field}_{m.op}"]


def _where(filters: dict[str, list[str | None]]) -> str:
    out = []
    for d, values in filters.items():
        some = ", ".join(f"'{v}'" for v in values if v is not None)
        parts = ([f"{d} IN ({some})"] if some else []) + ([f"{d} IS NULL"] if None in values else [])
        out.append("(" + " OR ".join(parts) + ")")
    return " AND ".join(out) or "TRUE"


def request_sql(contract: Contract, spec: QuerySpec) -> str:
    """A request as SQL over the raw events."""
    family = contract.family(spec.family)
    measures = [x for m in family.measures if not spec.measures or m.name in spec.measures for x in _measure_sql(m)]
    keys = "".join(f", {d}" for d in spec.group_by)
    where = f"timestamp_ns >= {spec.start_ns} AND timestamp_ns < {spec.end_ns} AND {_where(spec.filters)}"
    return f"SELECT {_bucket_sql(contract.bucket_ns)} AS bucket_ns{keys}, {', '.join(measures)} FROM ev WHERE {where} GROUP BY ALL"


def request(name: str, contract: Contract, spec: QuerySpec, layout: str | None = "separate") -> None:
    """Registers a request: answered from views, or with layout None by scanning events."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if layout is None:
            return flat(query.from_events(canonical_events(spark, sf_dir), contract, spec, order=False))
        return flat(query.over_cells(view(spark, sf_dir, contract, spec.family, layout), contract, spec, order=False))

    register(name, request_sql(contract, spec))(run)


# Requests on raw events.
request("filter_time_range", MINUTE, QuerySpec("event-volume", *WEEK, group_by=("service",)), None)
request("filter_eq", MINUTE, QuerySpec("event-volume", *EVERYTHING, {"status": ["ERROR"]}, ("service", "event_type")), None)
request("filter_two_eq", MINUTE, QuerySpec("event-volume", *EVERYTHING, {"status": ["OK"], "service": ["svc-003"]}, ("event_type",)), None)
request("filter_in", MINUTE, QuerySpec("event-volume", *EVERYTHING, {"service": ["svc-001", "svc-007"]}, ("service", "status")), None)
request("filter_null", MINUTE, QuerySpec("model-usage", *EVERYTHING, {"model": [None]}, ("service", "model")), None)
request("filter_in_null", MINUTE, QuerySpec("model-usage", *EVERYTHING, {"model": [None, "model-3"]}, ("model",)), None)
request("group_subset", MINUTE, QuerySpec("traffic", *EVERYTHING, group_by=("service",)), None)
request("measure_subset", MINUTE, QuerySpec("latency", *EVERYTHING, group_by=("service",), measures=("duration_ns:max",)), None)
request("volume_count", DAY, QuerySpec("event-volume", *EVERYTHING, group_by=("service", "event_type")), None)
request("latency_count_present", DAY, QuerySpec("latency", *EVERYTHING, group_by=("service", "status"), measures=("duration_ns:count_present",)), None)
request("traffic_sum", DAY, QuerySpec("traffic", *EVERYTHING, group_by=("service", "status")), None)
request("latency_min_max", DAY, QuerySpec("latency", *EVERYTHING, group_by=("service",), measures=("duration_ns:min", "duration_ns:max")), None)
request("latency_histogram", DAY, QuerySpec("latency", *EVERYTHING, group_by=("service",), measures=("duration_ns:histogram",)), None)
for _f in MINUTE.families:
    _every = QuerySpec(_f.name, *EVERYTHING, group_by=_f.dimensions)
    request(f"oracle_{_f.name.replace('-', '_')}", MINUTE, _every, None)
    request(f"view_{_f.name.replace('-', '_')}", MINUTE, _every)
# Requests on views.
request("regroup_service", DAY, QuerySpec("latency", *WEEK, {"status": ["OK"]}, ("service",)))
request("regroup_bucket_only", DAY, QuerySpec("latency", *EVERYTHING))
request("regroup_two_dims", DAY, QuerySpec("error-volume", *EVERYTHING, group_by=("error_code", "severity")))
request("regroup_histogram", DAY, QuerySpec("latency", *EVERYTHING, group_by=("status",), measures=("duration_ns:histogram",)))
request("model_usage_null_sum", DAY, QuerySpec("model-usage", *EVERYTHING, group_by=("model",)))
request("unified_regroup", DAY, QuerySpec("traffic", *EVERYTHING, {"status": ["OK"]}, ("service",)), "unified")

ATTRIBUTES = contracts.parse(
    'version = 1\nname = "attributes"\ntime_bucket = "1d"\n[retention]\nrecent = "24h"\nerror_severities = []\nerror_statuses = []\n'
    '[[families]]\nname = "regions"\ndimensions = ["service", "attributes.region"]\nmeasures = [{ field = "*", op = "count" }]\n'
)


@register("group_attribute", f"SELECT {_bucket_sql(DAY_NS)} AS bucket_ns, region AS attributes_region, count(*) AS count FROM ev GROUP BY ALL")
def group_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = QuerySpec("regions", *EVERYTHING, group_by=("attributes.region",))
    return flat(query.over_cells(view(spark, sf_dir, ATTRIBUTES, "regions"), ATTRIBUTES, spec, order=False))


@register("grouping_sets", f"SELECT CASE WHEN grouping(service) = 0 THEN 0 ELSE 1 END AS grouping_set, {_bucket_sql(DAY_NS)} AS bucket_ns, service, status, CAST(sum(bytes_in) AS BIGINT) AS bytes_in_sum, CAST(sum(bytes_out) AS BIGINT) AS bytes_out_sum FROM ev GROUP BY GROUPING SETS (({_bucket_sql(DAY_NS)}, service), ({_bucket_sql(DAY_NS)}, status))")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = DAY.family("traffic").measures
    out = state.grouping_sets(view(spark, sf_dir, DAY, "traffic"), [("service",), ("status",)], list(m))
    return out.select("grouping_set", "bucket_ns", "service", "status", *[state.quoted(state.stem(x)).alias(f"{x.field}_sum") for x in m])


# Scans and checks of sources.
@register("scan_canonical", "SELECT event_id, timestamp_ns, service, severity, duration_ns, tokens_in FROM ev")
def scan_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.canonical import canonical_json

    lines = canonical_events(spark, sf_dir).select(canonical_json().alias("value"))
    return scan(lines).where("problem is null").select("event_id", "timestamp_ns", "service", "severity", "duration_ns", "tokens_in")


@register("validate_events", "SELECT CASE WHEN service < 'svc-004' THEN 'service must not be empty' ELSE 'valid' END AS problem, count(*) AS n FROM ev GROUP BY ALL")
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = canonical_events(spark, sf_dir).withColumn("service", F.when(F.col("service") < "svc-004", "").otherwise(F.col("service")))
    return spoilt.groupBy(F.coalesce(violation(), F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@register("duplicate_event_ids", "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM ev UNION ALL SELECT event_id FROM ev WHERE status = 'ERROR') GROUP BY 1 HAVING count(*) > 1")
def duplicate_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    return duplicate_ids(e.select("event_id").unionByName(e.where("status = 'ERROR'").select("event_id")))


@register("source_stats", "SELECT count(*) AS event_count, min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, count(*) FILTER (WHERE status = 'ERROR') AS error_count FROM ev")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_stats(canonical_events(spark, sf_dir), tiers.is_error(MINUTE.retention))


@register("raw_parquet_latency", request_sql(DAY, QuerySpec("latency", *EVERYTHING, group_by=("status",))))
def raw_parquet_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(query.from_events(canonical_events(spark, sf_dir), DAY, QuerySpec("latency", *EVERYTHING, group_by=("status",)), order=False))


@register("view_scan", f"SELECT {_bucket_sql(BUCKET_NS)} AS bucket_ns, service, event_type, severity, status, count(*) AS count FROM ev GROUP BY ALL")
def view_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MINUTE, "event-volume")


@register("bucketize", f"SELECT event_id, {_bucket_sql(7 * DAY_NS, '(timestamp_ns - 1705000000000000000)')} AS bucket_ns FROM ev")
def bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).select("event_id", bucket_start(F.col("timestamp_ns") - F.lit(1_705_000_000_000_000_000), 7 * DAY_NS).alias("bucket_ns"))


# Tiers.
_TIER = f"SELECT *, CASE WHEN severity IN ('ERROR', 'FATAL') OR status = 'ERROR' THEN 'errors' WHEN timestamp_ns >= (SELECT max(timestamp_ns) FROM ev) - {RECENT_NS} THEN 'recent' END AS tier FROM ev"


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = canonical_events(spark, sf_dir)
    bounds = events.agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high")).first()
    return tiers.classified(events, MINUTE.retention, tiers.cutoff_ns(MINUTE.retention, bounds["low"] or 0, bounds["high"] or 0))


def _kept(spark: SparkSession, sf_dir: str, which: str, filters: dict | None = None) -> DataFrame:
    t = tiered(spark, sf_dir)
    found = tiers.filtered(tiers.retained(t.where("tier = 'errors'"), t.where("tier = 'recent'"), which), filters or {})
    return found.select("event_id", "timestamp_ns", "service", "error_code", "tier")


for _name, _which, _filters, _sql in (
    ("events_all", "all", {}, "tier IS NOT NULL"),
    ("events_recent", "recent", {}, "tier = 'recent'"),
    ("events_errors", "errors", {}, "tier = 'errors'"),
    ("events_filtered", "all", {"service": ["svc-002", "svc-005"], "model": [None]}, "tier IS NOT NULL AND service IN ('svc-002', 'svc-005') AND model IS NULL"),
):
    register(_name, f"SELECT event_id, timestamp_ns, service, error_code, tier FROM ({_TIER}) WHERE {_sql}")(lambda s, d, w=_which, f=_filters: _kept(s, d, w, f))


@register("classify_errors", "SELECT status = 'ERROR' AND service <> 'svc-006' OR service = 'svc-005' AS is_error, count(*) AS n FROM ev GROUP BY ALL")
def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity and status each decide by themselves: one service's events are fatal though OK, another's errors are neither."""
    e = canonical_events(spark, sf_dir)
    e = e.withColumn("severity", F.when(F.col("service") == "svc-005", "FATAL").when(F.col("service") == "svc-006", "INFO").when(F.col("service") == "svc-007", "WARN").otherwise(F.col("severity")))
    e = e.withColumn("status", F.when(F.col("service") == "svc-006", "UNSET").when(F.col("service") == "svc-005", "OK").otherwise(F.col("status")))
    return e.groupBy(tiers.is_error(MINUTE.retention).alias("is_error")).agg(F.count("*").alias("n"))


@register("raw_recoverability", f"SELECT count(tier) AS retained, count(*) AS total, CAST(count(tier) * 1000000 // count(*) AS BIGINT) AS parts_per_million FROM ({_TIER})")
def raw_recoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tiered(spark, sf_dir).agg(F.count("tier").alias("retained"), F.count("*").alias("total"))
    return out.select("retained", "total", F.expr("retained * 1000000 div total").alias("parts_per_million"))


# Dictionaries.
_DICTIONARY = "SELECT 0 AS id, CAST(NULL AS VARCHAR) AS value UNION ALL SELECT row_number() OVER (ORDER BY {0}), {0} FROM (SELECT DISTINCT {0} FROM ev WHERE {0} IS NOT NULL)"


@register("dictionary_service", _DICTIONARY.format("service"))
def dictionary_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.build(canonical_events(spark, sf_dir), "service")


@register("dictionary_encode", f"SELECT event_id, d.id AS model_id FROM ev JOIN ({_DICTIONARY.format('model')}) d ON ev.model IS NOT DISTINCT FROM d.value")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    return dictionary.encode(e, "model", dictionary.build(e, "model"), "model_id").select("event_id", "model_id")


@register("dictionary_decode", "SELECT event_id, model FROM ev")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    d = dictionary.build(e, "model")
    return dictionary.decode(dictionary.encode(e, "model", d, "model_id").select("event_id", "model_id"), "model_id", d, "model").select("event_id", "model")


@register("dimension_values", "SELECT DISTINCT error_code AS value FROM ev ORDER BY value NULLS FIRST LIMIT 4")
def dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.values(canonical_events(spark, sf_dir), "error_code", 4)


@register("dimension_cardinality", " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(DISTINCT {d}) + 1 AS \"values\" FROM ev" for d in ("service", "operation", "model", "error_code")))
def dimension_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.cardinality(canonical_events(spark, sf_dir), ["service", "operation", "model", "error_code"])


# Integrity: one row with the number of violations.
def _violations(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations"))


@register("tier_overlap", f"SELECT count(*) AS violations FROM ({_TIER}) WHERE tier = 'errors' AND service = 'svc-001'")
def tier_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recent tier is damaged: one service's errors are in it too."""
    t = tiered(spark, sf_dir)
    recent = t.where("tier = 'recent' or (tier = 'errors' and service = 'svc-001')")
    return _violations(t.where("tier = 'errors'").join(recent, "event_id", "left_semi"))


@register("tier_membership", f"SELECT tier, count(*) AS n, count(*) FILTER (WHERE (tier = 'errors') <> (status = 'ERROR')) AS violations FROM ({_TIER}) WHERE tier IS NOT NULL GROUP BY ALL")
def tier_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = tiers.is_error(MINUTE.retention)
    return tiered(spark, sf_dir).where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.count_if((F.col("tier") == "errors") != error).alias("violations"))


_CELLS = f"(SELECT DISTINCT {_bucket_sql(BUCKET_NS)} AS bucket_ns, service, operation, status FROM ev WHERE {{}})"


@register("view_sorted_unique", f"SELECT (SELECT count(*) FROM {_CELLS.format("service = 'svc-002'")}) AS repeated, (SELECT count(*) - 1 FROM {_CELLS.format("service = 'svc-003'")}) AS unsorted, CAST(0 AS BIGINT) AS unsorted_as_written")
def view_sorted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view in which one service's cells are there twice, and one whose cells are written in falling order."""
    v, dims = view(spark, sf_dir, MINUTE, "latency"), MINUTE.family("latency").dimensions
    twice = verify.repeated_keys(v.unionByName(v.where("service = 'svc-002'")), dims)
    path = f"{shared_dir(spark)}/falling-{uuid.uuid4().hex}"
    few = v.where("service = 'svc-003'")
    few.repartition(1, F.lit(0)).sortWithinPartitions(*[state.quoted(c).desc_nulls_last() for c in (state.BUCKET, *dims)]).write.parquet(path)
    counts = [(twice, "repeated"), (verify.unsorted_rows(spark.read.parquet(path), dims), "unsorted"), (verify.unsorted_rows(v, dims), "unsorted_as_written")]
    rows = [df.agg(F.count("*").alias(name)) for df, name in counts]
    return rows[0].withColumn("__k", F.lit(0)).join(rows[1].withColumn("__k", F.lit(0)), "__k").join(rows[2].withColumn("__k", F.lit(0)), "__k").drop("__k")


@register("view_invariants", f"SELECT (SELECT count(*) FROM {_CELLS.format("service < 'svc-004' AND duration_ns IS NOT NULL")}) AS least_above_greatest, (SELECT count(*) FROM {_CELLS.format("service = 'svc-005'")}) AS bins_off, CAST(0 AS BIGINT) AS as_written")
def view_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells damaged in two ways, and none."""
    measures = layouts.route(layouts.separate(MINUTE), "latency").measures
    v = view(spark, sf_dir, MINUTE, "latency").withColumn("__how", F.when(F.col("service") < "svc-004", "least").when(F.col("service") == "svc-005", "bins"))
    low, high, bin_ = (state.stem(next(m for m in measures if m.op == op)) for op in ("min", "max", "histogram"))
    broken = v.withColumn(low, F.when(F.col("__how") == "least", F.col(high) + 1).otherwise(F.col(low))).withColumn(f"{bin_}__0", F.when(F.col("__how") == "bins", F.col(f"{bin_}__0") + 1).otherwise(F.col(f"{bin_}__0")))
    bad, how = verify.broken_state(measures), F.col("__how")
    return broken.agg(F.count_if(bad & (how == "least")).alias("least_above_greatest"), F.count_if(bad & (how == "bins")).alias("bins_off"), F.count_if(bad & how.isNull()).alias("as_written"))


@register("verify_view_vs_raw", f"SELECT count(*) AS violations FROM (SELECT DISTINCT {_bucket_sql(BUCKET_NS)}, service, status FROM ev WHERE service = 'svc-003')")
def verify_view_vs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that lost one service's events: just its answers differ."""
    spec = QuerySpec("latency", *EVERYTHING, group_by=("service", "status"))
    got = query.over_cells(view(spark, sf_dir, MINUTE, "latency"), MINUTE, spec, order=False)
    return _violations(verify.difference(got, query.from_events(canonical_events(spark, sf_dir).where("service <> 'svc-003'"), MINUTE, spec, order=False)))


# An archive, written, opened and read.
_ROWS = "SELECT '{0}' AS part, count(*) AS n FROM ({1})"
_ARCHIVED = " UNION ALL ".join(
    [_ROWS.format(f"views/{v.name}", f"SELECT DISTINCT {_bucket_sql(DAY_NS)}, {', '.join(v.dimensions)} FROM ev") for v in layouts.separate(DAY)]
    + [_ROWS.format(f"tiers/{t}", f"SELECT 1 FROM ({_TIER}) WHERE tier = '{t}'") for t in ("errors", "recent")]
    + [_ROWS.format(f"dictionaries/{d}", f"SELECT DISTINCT {d} FROM ev WHERE {d} IS NOT NULL UNION ALL SELECT NULL") for d in ("error_code", "event_type", "model", "operation", "service", "severity", "status")]
)


@register("archive_round_trip", _ARCHIVED)
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every part of an archive that was encoded, verified, published and opened."""
    a = archive.encode(canonical_events(spark, sf_dir), DAY, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}", archive.EncodeOptions("separate"))
    parts = [(f"views/{v.name}", a.view(v.name)) for v in a.views] + [(f"tiers/{t}", a.tier(t)) for t in archive.TIERS] + [(f"dictionaries/{d}", a.dictionary(d)) for d in a.manifest["dictionaries"]]
    out = None
    for name, df in parts:
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@register("inspect_source", f"SELECT count(*) AS event_count, (SELECT count(*) FROM ({_TIER}) WHERE tier = 'errors') AS errors, (SELECT count(*) FROM ({_TIER}) WHERE tier = 'recent') AS recent, min(timestamp_ns) AS min_timestamp_ns, max(timestamp_ns) AS max_timestamp_ns, max(timestamp_ns) - {RECENT_NS} AS cutoff_ns FROM ev")
def inspect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive.encode(canonical_events(spark, sf_dir), DAY, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}", archive.EncodeOptions("separate", dictionaries=False))
    info = a.inspect()
    Store(spark, a.path).delete()
    row = (info["event_count"], info["tier_counts"]["errors"], info["tier_counts"]["recent"], info["min_timestamp_ns"], info["max_timestamp_ns"], info["cutoff_ns"])
    return spark.createDataFrame([row], "event_count long, errors long, recent long, min_timestamp_ns long, max_timestamp_ns long, cutoff_ns long")


# Rejections and text sources.
_NUMBER = "CAST(substr(event_id, 5) AS BIGINT)"


@register("reject_lines", f"SELECT CASE {_NUMBER} % 7 WHEN 0 THEN 'unknown field surprise' WHEN 1 THEN 'duration_ns must be a 64-bit integer' WHEN 2 THEN 'attributes must be an object of text or null' WHEN 3 THEN 'duration_ns must be a 64-bit integer' WHEN 4 THEN 'not a JSON document, or a key twice' ELSE 'valid' END AS problem, count(*) AS n FROM ev GROUP BY ALL")
def reject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines spoilt by number: an unknown field, a fraction, a nested attribute, a number beyond 64 bits, a key twice."""
    from .sources.canonical import canonical_json

    number = F.substring("event_id", 5, 12).cast("long") % 7
    lines = canonical_events(spark, sf_dir).select(number.alias("k"), canonical_json().alias("value"))
    swaps = {0: (r"^\{", '{"surprise":1,'), 1: (r'"duration_ns":-?\d+', '"duration_ns":1.5'), 2: (r'"attributes":\{', '"attributes":{"n":{"x":1},'), 3: (r'"duration_ns":-?\d+', '"duration_ns":99999999999999999999'), 4: (r"^\{", '{"service":"twice",')}
    value = F.col("value")
    for k, (old, new) in swaps.items():
        value = F.when(F.col("k") == k, F.regexp_replace("value", old, new)).otherwise(value)
    return scan(lines.select(value.alias("value"))).groupBy(F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


@register("gzip_lines", "SELECT event_id, timestamp_ns, operation, bytes_out FROM ev")
def gzip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.canonical import read_lines, write_jsonl

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    write_jsonl(canonical_events(spark, sf_dir), path, "gzip")
    return scan(read_lines(spark, path)).where("problem is null").select("event_id", "timestamp_ns", "operation", "bytes_out")


@register("malformed_lines", f"SELECT CASE WHEN {_NUMBER} % 50 = 0 THEN 'unparsed' ELSE 'log.record' END AS event_type, {_NUMBER} % 50 = 0 AS warning, count(*) AS n FROM ev GROUP BY ALL")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of which one in fifty is too short."""
    e = canonical_events(spark, sf_dir).withColumn("index", F.substring("event_id", 5, 12).cast("long"))
    line = F.when(F.col("index") % 50 == 0, "short").otherwise(F.concat_ws(" ", F.lit("-"), F.expr("timestamp_ns div 1000000000").cast("string"), F.lit("2024.01.01 node t n RAS KERNEL INFO text")))
    return adapters.bgl(e.select(line.alias("value"), "index")).groupBy("event_type", "warning").agg(F.count("*").alias("n"))


@register("ordered_answer", f"SELECT {_bucket_sql(DAY_NS)} AS bucket_ns, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in_sum, CAST(sum(tokens_out) AS BIGINT) AS tokens_out_sum FROM ev GROUP BY ALL ORDER BY bucket_ns, model NULLS FIRST LIMIT 25")
def ordered_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answers in their order, which decides which these are."""
    spec = QuerySpec("model-usage", *EVERYTHING, group_by=("model",))
    return flat(query.from_events(canonical_events(spark, sf_dir), DAY, spec).limit(25))


@register("cardinality_over_ceiling", " UNION ALL ".join(f"SELECT '{d}' AS dimension, count(DISTINCT {d}) + 1 AS \"values\" FROM ev HAVING count(DISTINCT {d}) + 1 > 9" for d in ("service", "operation", "model", "error_code")))
def cardinality_over_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.cardinality(canonical_events(spark, sf_dir), ["service", "operation", "model", "error_code"]).where(F.col("values") > 9)


@register("illegal_requests", "SELECT range AS query, TRUE AS rejected FROM range(20)")
def illegal_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = canonical_events(spark, sf_dir).agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high")).first()

    def rejected(spec: QuerySpec) -> bool:
        try:
            admit(MINUTE, spec)
        except QueryRejected:
            return True
        return False

    rows = [(i, rejected(s)) for i, s in enumerate(workload.illegal(MINUTE, bounds["low"], bounds["high"]))]
    return spark.createDataFrame(rows, "query long, rejected boolean")


@register("generated_frame", f"SELECT 'evt-' || lpad(CAST(i AS VARCHAR), 12, '0') AS event_id, CAST({generator.START_NS} + CAST(i AS HUGEINT) * {generator.SPAN_NS} // 10000 AS BIGINT) AS timestamp_ns, 'trace-' || lpad(CAST(i // 8 AS VARCHAR), 10, '0') AS trace_id, CASE WHEN i % 8 <> 0 THEN 'span-' || lpad(CAST(i - 1 AS VARCHAR), 12, '0') END AS parent_span_id, i % 5 = 0 AS has_model, i % 5 = 0 AS has_tokens FROM (SELECT range AS i FROM range(10000))")
def generated_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the generator's events doesn't depend on chance."""
    e = generator.generate(spark, "standard", 10_000, 7)
    return e.select("event_id", "timestamp_ns", "trace_id", "parent_span_id", F.col("model").isNotNull().alias("has_model"), (F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()).alias("has_tokens"))


@register("generated_rates", "SELECT * FROM (VALUES ('standard', 20000, TRUE, TRUE, 16, TRUE), ('low-cardinality', 20000, TRUE, TRUE, 4, TRUE), ('error-burst', 20000, TRUE, TRUE, 16, TRUE), ('out-of-order', 20000, TRUE, TRUE, 16, TRUE)) t(scenario, events, errors_as_stated, within_bounds, services, skewed)")
def generated_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of errors within three in a thousand of what a scenario states, bounds of values, and the skew of operations."""
    out = None
    expected = {"standard": 0.01, "low-cardinality": 0.001, "error-burst": 0.01 + 0.24 / 120, "out-of-order": 0.01}
    for name, rate in expected.items():
        s, e = generator.SCENARIOS[name], generator.generate(spark, name, 20_000, 11)
        bounds = F.col("duration_ns").between(500_000, 1_500_499_999) & F.col("bytes_in").between(64, 65_535) & F.col("bytes_out").between(64, 262_143)
        low = F.count_if(F.substring("operation", 11, 6).cast("int") < s.operations // 2)
        row = e.agg(F.count("*").cast("int").alias("events"), (F.abs(F.avg((F.col("status") == "ERROR").cast("int")) - rate) < 0.003).alias("errors_as_stated"), F.every(bounds).alias("within_bounds"), F.countDistinct("service").cast("int").alias("services"), (low / F.count("*") > 0.7).alias("skewed"))
        row = row.select(F.lit(name).alias("scenario"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# Adapters: log lines made of events, parsed back.
_MS = "strftime(epoch_ms(timestamp_ns // 1000000), '%Y-%m-%d %H:%M:%S,%g')"
_LEVEL = "CASE WHEN status = 'ERROR' THEN 'ERROR' ELSE 'INFO' END"


@register("zookeeper_parse", f"SELECT timestamp_ns // 1000000 * 1000000 AS timestamp_ns, operation, {_LEVEL} AS severity, status, CASE WHEN status = 'ERROR' THEN 'LOG_ALERT' END AS error_code, FALSE AS warning FROM ev")
def zookeeper_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    at = F.date_format(F.timestamp_millis(F.expr("timestamp_ns div 1000000")), "yyyy-MM-dd HH:mm:ss,SSS")
    line = F.concat(at, F.lit(" - "), F.col("severity"), F.lit("  [main:"), F.col("operation"), F.lit("@101] - "), F.col("event_type"))
    lines = e.select(line.alias("value"), F.regexp_extract("event_id", r"(\d+)$", 1).cast("long").alias("index"))
    return adapters.zookeeper(lines).select("timestamp_ns", "operation", "severity", "status", "error_code", "warning")


@register("bgl_parse", f"SELECT timestamp_ns // 1000000000 * 1000000000 AS timestamp_ns, service AS operation, {_LEVEL} AS severity, status, 'node-' || event_type AS node, 'RAS' AS facility, FALSE AS warning FROM ev")
def bgl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    line = F.concat_ws(" ", F.when(F.col("status") == "ERROR", "APPREAD").otherwise("-"), F.expr("timestamp_ns div 1000000000").cast("string"), F.lit("2024.01.01"), F.concat(F.lit("node-"), "event_type"), F.lit("t n RAS"), F.col("service"), F.lit("INFO text"))
    lines = e.select(line.alias("value"), F.regexp_extract("event_id", r"(\d+)$", 1).cast("long").alias("index"))
    return adapters.bgl(lines).select("timestamp_ns", "operation", "severity", "status", F.col("attributes")["node"].alias("node"), F.col("attributes")["facility"].alias("facility"), "warning")


# Without SQL.
@register("generate_standard")
def generate_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generator.generate(spark, "standard", 10_000, 7)


class _Views:
    """The views of the test table, as ``query.batch`` wants an archive."""

    def __init__(self, spark: SparkSession, sf_dir: str, contract: Contract):
        self.contract, self.views = contract, tuple(layouts.separate(contract))
        self._of = {v.name: view(spark, sf_dir, contract, v.families[0]) for v in self.views}

    def view(self, name: str) -> DataFrame:
        return self._of[name]


def legal_workload(spark: SparkSession, sf_dir: str, contract: Contract = MINUTE) -> tuple[_Views, list[QuerySpec]]:
    archive_ = _Views(spark, sf_dir, contract)
    bounds = canonical_events(spark, sf_dir).agg(F.min("timestamp_ns").alias("low"), F.max("timestamp_ns").alias("high")).first()
    values = workload.first_values({f.name: archive_.view(layouts.route(list(archive_.views), f.name).name) for f in contract.families}, contract)
    return archive_, workload.legal(contract, bounds["low"], bounds["high"], values)


def _workload_sql(contract: Contract) -> str:
    """The 200 requests over raw events, with bounds and filter values found by SQL."""
    width, names = contract.bucket_ns, list(dict.fromkeys(x.rsplit(" AS ", 1)[1] for f in contract.families for m in f.measures for x in _measure_sql(m)))
    most = max(len(f.dimensions) for f in contract.families)
    parts, number = [], 0
    for f in contract.families:
        have = {x.rsplit(" AS ", 1)[1]: x for m in f.measures for x in _measure_sql(m)}
        first = [x.rsplit(" AS ", 1)[1] for x in _measure_sql(f.measures[0])]
        for i in range(workload.EACH):
            length = workload.WINDOWS[i % len(workload.WINDOWS)]
            begin = "b.s" if length is None else f"greatest(b.s, b.e - {length * width})"
            one, two = f.dimensions[0], f.dimensions[1] if len(f.dimensions) > 1 else f.dimensions[0]
            picks = ({}, {one: 1}, {one: 1, two: 1}, {one: 2})[i // 10]
            where = "".join(f" AND EXISTS (SELECT 1 FROM vals WHERE vals.d = '{d}' AND vals.n <= {n} AND vals.v IS NOT DISTINCT FROM ev.{d})" for d, n in picks.items())
            group = f.dimensions[: 1 + i % len(f.dimensions)]
            keys = [f"{group[k]} AS group_{k + 1}" if k < len(group) else f"CAST(NULL AS VARCHAR) AS group_{k + 1}" for k in range(most)]
            cells = [have[n] if n in have and (i % 3 or n in first) else f"CAST(NULL AS BIGINT) AS {n}" for n in names]
            parts.append(f"SELECT {number} AS query, {_bucket_sql(width)} AS bucket_ns, {', '.join(keys)}, {', '.join(cells)} FROM ev, b WHERE timestamp_ns >= {begin} AND timestamp_ns < b.e{where} GROUP BY ALL")
            number += 1
    dims = dict.fromkeys(d for f in contract.families for d in f.dimensions[:2])
    values = " UNION ALL ".join(f"SELECT '{d}' AS d, v, row_number() OVER (ORDER BY v NULLS FIRST) AS n FROM (SELECT DISTINCT {d} AS v FROM ev)" for d in dims)
    bounds = f"SELECT {_bucket_sql(width, 'lo')} AS s, {_bucket_sql(width, 'hi')} + {width} AS e FROM (SELECT min(timestamp_ns) AS lo, max(timestamp_ns) AS hi FROM ev)"
    return f"WITH ev AS MATERIALIZED ({EVENTS}), b AS MATERIALIZED ({bounds}), vals AS MATERIALIZED (SELECT * FROM ({values}) WHERE n <= 2) " + " UNION ALL ".join(parts)


@register("workload_batch")
def workload_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 different requests over five time ranges, with one-minute buckets."""
    archive_, specs = legal_workload(spark, sf_dir)
    return flat(query.batch(archive_, specs))


ORACLE_SQL["workload_batch"] = _workload_sql(MINUTE)
