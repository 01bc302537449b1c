"""Benchmark rows, their loading, and summaries."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, query, workload
from .errors import BenchmarkError, QueryRejected
from .files import Store, shared_dir
from .operators import state
from .plans import layout as layouts
from .plans.admission import admit
from .plans.contract import Contract
from .sources import canonical

ROW_VERSION = 1
REQUIRED = ("schema_version", "dataset", "baseline", "status")
COLUMNS = "schema_version int, dataset string, baseline string, status string, error string, archive_bytes long, canonical_bytes long, event_count long, encode_ms double, query_batch_ms double, legal_queries int, rejected_queries int, raw_recoverability double, host string"


def ratios(row: dict) -> dict:
    """Compression ratio, bytes an event, MiB a second of encoding; null where they mean nothing."""
    div = lambda a, b: a / b if a is not None and b else None
    mib = div(row.get("canonical_bytes"), 1 << 20)
    return {"ratio": div(row.get("canonical_bytes"), row.get("archive_bytes")), "bytes_per_event": div(row.get("archive_bytes"), row.get("event_count")), "encode_mib_s": div(mib, (row.get("encode_ms") or 0) / 1000)}


def host() -> str:
    return f"{platform.machine()} {os.cpu_count()} CPUs {platform.system()}"


def append(path: str, rows: list[dict]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(json.dumps(r, sort_keys=True) + "\n" for r in rows)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a benchmark file, checked: needed keys, version, and no success without a size."""
    df = canonical.infer_json(spark, path, {c: k for c, k in (x.strip().split(" ") for x in COLUMNS.split(","))})
    bad = F.lit(False)
    for c in REQUIRED:
        bad |= F.col(c).isNull()
    bad |= (F.col("schema_version") != ROW_VERSION) | ((F.col("status") == "success") & F.col("archive_bytes").isNull())
    if not df.where(bad).isEmpty():
        raise BenchmarkError(f"{path} has rows of another kind")
    return df


def primary(rows: DataFrame) -> DataFrame:
    """Medians of successful rows by dataset and baseline."""
    return rows.where("status = 'success'").groupBy("dataset", "baseline").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("archive_bytes", "encode_ms", "query_batch_ms")], F.count("*").alias("trials"))


def failures(rows: DataFrame) -> DataFrame:
    return rows.where("status <> 'success'").groupBy("dataset", "baseline", "status").agg(F.count("*").alias("n"))


def percentile(values: list[float], q: float) -> float:
    return float(np.percentile(values, q))


def median_ratio_interval(a: list[float], b: list[float], draws: int = 10_000, seed: int = 23, level: float = 0.95) -> tuple[float, float]:
    """Bootstrap interval of the ratio of medians."""
    rng = np.random.default_rng(seed)
    pick = lambda x: np.median(np.array(x)[rng.integers(0, len(x), (draws, len(x)))], axis=1)
    r = pick(a) / pick(b)
    return tuple(float(x) for x in np.quantile(r, [(1 - level) / 2, (1 + level) / 2]))


def check_source(path: str, most_bytes: int, sha256: str) -> None:
    """A local corpus file must be as small and the same as its lock says."""
    size = os.path.getsize(path)
    if size > most_bytes:
        raise BenchmarkError(f"{path} has {size} bytes; the limit is {most_bytes}")
    with open(path, "rb") as f:
        if hashlib.file_digest(f, "sha256").hexdigest() != sha256:
            raise BenchmarkError(f"{path} isn't the file that was locked")


def bench_canonical(spark: SparkSession, path: str, dataset: str, contract: Contract, output: str, layouts_: tuple[str, ...] = ("auto", "separate", "unified"), levels: tuple[int, ...] = (9,), raw: tuple[str, ...] = ("jsonl", "gzip-6", "parquet-raw-zstd")) -> dict:
    """Encodes a canonical source in each layout, answers the workload, compares with raw scans and appends rows.

    ``raw`` names the baselines that keep events only and answer by scanning them.
    """
    events = canonical.read_canonical(spark, path)
    size = spark.read.text(path).agg(F.sum(F.octet_length("value") + 1)).first()[0]
    rows = []
    for name in (*raw, *[(layout, level) for layout in layouts_ for level in levels]):
        work = Store(spark, f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}")
        row = {"schema_version": ROW_VERSION, "dataset": dataset, "baseline": name if isinstance(name, str) else f"{name[0]}-zstd{name[1]}", "host": host(), "canonical_bytes": size}
        try:
            row |= (_raw_baseline(events, contract, name, work) if isinstance(name, str) else _archive_baseline(events, contract, *name, work)) | {"status": "success"}
        except Exception as e:  # a failure is a row too
            row |= {"status": "failure", "failure_kind": type(e).__name__, "error": str(e)[:500]}
        finally:
            work.delete()
        rows.append(row | ratios(row))
    append(output, rows)
    return {"rows": rows}


def _archive_baseline(events: DataFrame, contract: Contract, layout: str, level: int, work: Store) -> dict:
    began = time.perf_counter()
    found = archive.encode(events, contract, f"{work.root}/a", archive.EncodeOptions(layout, zstd_level=level))
    encode_ms = (time.perf_counter() - began) * 1000
    info, m = found.inspect(), found.manifest
    views = {f.name: found.view(layouts.route(list(found.views), f.name).name) for f in contract.families}
    specs = workload.legal(contract, m["min_timestamp_ns"], m["max_timestamp_ns"], workload.first_values(views, contract))
    began = time.perf_counter()
    query.batch(found, specs).write.format("noop").mode("overwrite").save()
    return {"encode_ms": encode_ms, "query_batch_ms": (time.perf_counter() - began) * 1000, "archive_bytes": sum(info["component_bytes"].values()), "event_count": m["event_count"], "raw_recoverability": info["raw_recoverability"], "legal_queries": len(specs), "rejected_queries": sum(_rejected(contract, s) for s in workload.illegal(contract, m["min_timestamp_ns"], m["max_timestamp_ns"]))}


def _raw_baseline(events: DataFrame, contract: Contract, name: str, work: Store) -> dict:
    """Events as text or Parquet; requests are answered from cells folded out of them in the same pass."""
    spark, place = events.sparkSession, f"{work.root}/raw"
    began = time.perf_counter()
    if name == "parquet-raw-zstd":
        events.write.option("compression", "zstd").parquet(place)
    else:
        canonical.write_jsonl(events, place, {"jsonl": "none", "gzip-6": "gzip"}[name])
    encode_ms = (time.perf_counter() - began) * 1000
    size = spark.read.format("binaryFile").load(place).agg(F.sum("length")).first()[0]
    began = time.perf_counter()
    back = spark.read.parquet(place) if name == "parquet-raw-zstd" else canonical.scan(canonical.read_lines(spark, place)).drop("value", "problem")
    scanned = _Scanned(back, contract)
    low, high = back.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    specs = workload.legal(contract, low, high, workload.first_values({f.name: scanned.view(layouts.route(list(scanned.views), f.name).name) for f in contract.families}, contract))
    query.batch(scanned, specs).write.format("noop").mode("overwrite").save()
    return {"encode_ms": encode_ms, "query_batch_ms": (time.perf_counter() - began) * 1000, "archive_bytes": size, "event_count": back.count(), "raw_recoverability": 1.0, "legal_queries": len(specs)}


class _Scanned:
    """Cells folded from raw events whenever they are read."""

    def __init__(self, events: DataFrame, contract: Contract):
        self.events, self.contract, self.views = events, contract, tuple(layouts.separate(contract))

    def view(self, name: str) -> DataFrame:
        v = next(v for v in self.views if v.name == name)
        return state.cells(self.events, self.contract.bucket_ns, v.dimensions, v.measures)


def _rejected(contract: Contract, spec) -> bool:
    try:
        admit(contract, spec)
    except QueryRejected:
        return True
    return False
