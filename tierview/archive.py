"""Archives: cell views, raw tiers and dictionaries as Parquet, with a manifest.

An archive is a folder in any store that Spark reaches, published whole: it is written beside its place, verified and
renamed. ``manifest.json`` is written last and marks a complete archive, also where renaming isn't atomic.
The source is read once: validated events are written beside the archive, and everything else reads those.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import query as query_module
from .errors import ContractError, CorruptArchive, InputError
from .files import Store, written
from .functions.values import safe_name
from .operators import dictionary, state, tiers
from .plans import contract as contracts
from .plans import layout as layouts
from .plans.contract import Contract
from .plans.layout import View
from .sources.canonical import SCHEMA, check_unique, content_hash, source_stats

FORMAT, MANIFEST, CONTRACT = "tierview-archive-v1", "manifest.json", "contract.toml"
TIERS = ("errors", "recent")


@dataclass(frozen=True)
class EncodeOptions:
    layout: str = "auto"
    cardinality_limit: int = 10_000_000
    zstd_level: int = 9
    dictionaries: bool = True
    force: bool = False
    #: Output files of a view or tier: so many at least, and more with so many events a file.
    files: int = 8
    events_a_file: int = 5_000_000


def _write(df: DataFrame, path: str, level: int) -> None:
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def _dealt(df: DataFrame, time: str, order: list[str], files: int) -> DataFrame:
    """Dealt by day and, where a day has several files, by what follows in the order; sorted within.

    So row groups have narrow time ranges, no day is one task's, and the same input gives the same bytes.
    """
    slices = max(1, files // 8)
    keys = [F.floor(F.col(time) / contracts.DAY_NS), F.pmod(F.xxhash64(*[state.quoted(c) for c in order]), F.lit(slices))]
    return df.repartition(files, *keys).sortWithinPartitions(time, *[state.quoted(c).asc_nulls_first() for c in order])


def _logical(name: str) -> str:
    """A file's name without what differs from run to run."""
    folder, base = posixpath.split(name)
    return f"{folder}/{base[:10]}" if base.startswith("part-") else name


def encode(events: DataFrame, contract: Contract, path: str, options: EncodeOptions = EncodeOptions()) -> Archive:
    """Writes, verifies and publishes an archive of canonical events."""
    if options.layout not in ("auto", "separate", "unified"):
        raise ContractError(f"unknown layout {options.layout!r}")
    spark, path = events.sparkSession, path.rstrip("/")
    if Store(spark, path).exists() and not options.force:
        raise ContractError(f"{path} exists; use force to replace it")
    stage = Store(spark, f"{path}.staging-{uuid.uuid4().hex[:12]}")
    source = Store(spark, f"{stage.root}-events")
    try:
        events = written(events, source.root)
        stats = source_stats(events, tiers.is_error(contract.retention)).first().asDict()
        if not stats["event_count"]:
            raise InputError("there are no events")
        check_unique(events)
        names = sorted({d for f in contract.families for d in f.dimensions})
        dictionary.check_ceiling(events, names, options.cardinality_limit)
        cutoff = tiers.cutoff_ns(contract.retention, stats["min_timestamp_ns"], stats["max_timestamp_ns"])
        n_files = max(options.files, -(-stats["event_count"] // options.events_a_file))
        kinds = ["separate", "unified"] if options.layout == "auto" and layouts.unified_legal(contract) else ["separate" if options.layout == "auto" else options.layout]
        sizes: dict[str, int] = {}
        for kind in kinds:
            for v in layouts.plan(contract, kind):
                table = state.cells(events, contract.bucket_ns, v.dimensions, v.measures)
                _write(_dealt(table, state.BUCKET, list(v.dimensions), n_files), f"{stage.root}/{kind}/{v.name}", options.zstd_level)
            sizes[kind] = sum(stage.sizes(kind).values())
        layout = min(kinds, key=lambda k: (sizes[k], k != "separate"))
        for kind in kinds:
            if kind != layout:
                stage.delete(kind)
        stage.rename(layout, f"{stage.root}/views")
        kept = tiers.classified(events, contract.retention, cutoff)
        for tier in TIERS:
            _write(_dealt(kept.where(F.col("tier") == tier).drop("tier"), "timestamp_ns", ["event_id"], n_files), f"{stage.root}/tiers/{tier}", options.zstd_level)
        if options.dictionaries:
            for n in names:
                _write(dictionary.build(events, n).repartitionByRange("id").sortWithinPartitions("id"), f"{stage.root}/dictionaries/{safe_name(n)}", options.zstd_level)
        stage.write_text(CONTRACT, contract.source)
        views = layouts.plan(contract, layout)
        digests = stage.digests()
        files = {n: {"bytes": size, "sha256": digests[n]} for n, size in sorted(stage.sizes().items())}
        manifest = {
            "format": FORMAT, "layout": layout, "bucket_ns": contract.bucket_ns, "contract_hash": contract.digest(), "source_hash": content_hash(events), "cutoff_ns": cutoff,
            **stats, "tier_counts": {t: spark.read.parquet(f"{stage.root}/tiers/{t}").count() for t in TIERS},
            "views": [asdict(v) | {"rows": spark.read.parquet(f"{stage.root}/views/{v.name}").count()} for v in views], "candidate_bytes": sizes, "dictionaries": names if options.dictionaries else [], "files": files,
        }
        manifest["archive_hash"] = archive_hash(manifest)
        stage.write_text(MANIFEST, json.dumps(manifest, indent=1, sort_keys=True))
        from .verify import verify

        verify(Archive.open(spark, stage.root))
        publish(spark, stage.root, path)
    finally:
        stage.delete()
        source.delete()
    return Archive.open(spark, path)


def archive_hash(manifest: dict) -> str:
    """Over the manifest without paths that differ from run to run."""
    body = {k: v for k, v in manifest.items() if k not in ("archive_hash", "files")}
    body["files"] = sorted((_logical(n), x["bytes"], x["sha256"]) for n, x in manifest["files"].items())
    return "sha256:" + hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def publish(spark: SparkSession, stage: str, path: str) -> None:
    """Moves ``stage`` to ``path``; what was there comes back if that fails."""
    place, backup = Store(spark, path), f"{path}.old-{uuid.uuid4().hex[:12]}"
    had = place.exists()
    if had:
        place.rename("", backup)
    try:
        Store(spark, stage).rename("", path)
    except (OSError, Py4JJavaError):
        if had:
            Store(spark, backup).rename("", path)
        raise
    if had:
        Store(spark, backup).delete()


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str
    manifest: dict
    contract: Contract
    views: tuple[View, ...]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Archive:
        try:
            store = Store(spark, path)
            manifest = json.loads(store.read_text(MANIFEST))
            contract = contracts.parse(store.read_text(CONTRACT))
        except (OSError, Py4JJavaError, ValueError, ContractError) as e:
            raise CorruptArchive(f"{path} can't be opened: {e}") from e
        if manifest.get("format") != FORMAT:
            raise CorruptArchive(f"unsupported format {manifest.get('format')!r}")
        if manifest["contract_hash"] != contract.digest():
            raise CorruptArchive("the embedded contract was changed")
        return cls(spark, path, manifest, contract, tuple(layouts.plan(contract, manifest["layout"])))

    def view(self, name: str) -> DataFrame:
        """A view's cells; its columns must be what the contract says."""
        v = next(v for v in self.views if v.name == name)
        df = self.spark.read.parquet(f"{self.path}/views/{name}")
        if df.columns != [state.BUCKET, *v.dimensions, *state.cell_columns(v.measures)]:
            raise CorruptArchive(f"{name} has other columns than its contract")
        return df

    def tier(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/tiers/{name}")
        if df.columns != SCHEMA.names:
            raise CorruptArchive(f"tier {name} has other columns than the event model")
        return df

    def dictionary(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/dictionaries/{safe_name(name)}")

    def query(self, spec) -> DataFrame:
        return query_module.from_views(self, spec)

    def events(self, which: str = "all", filters: dict | None = None) -> DataFrame:
        found = tiers.retained(self.tier("errors"), self.tier("recent"), which)
        return tiers.filtered(found, filters or {})

    def inspect(self) -> dict:
        """What the archive has, and the bytes of its parts."""
        parts: dict[str, int] = {}
        for name, x in self.manifest["files"].items():
            part = name.split("/")[0]
            parts[part] = parts.get(part, 0) + x["bytes"]
        m = self.manifest
        kept = sum(m["tier_counts"].values())
        return {k: m[k] for k in ("format", "layout", "archive_hash", "contract_hash", "source_hash", "event_count", "error_count", "min_timestamp_ns", "max_timestamp_ns", "cutoff_ns", "tier_counts", "views")} | {
            "component_bytes": parts, "total_bytes": sum(parts.values()), "raw_recoverability": kept / m["event_count"],
            "families": {f.name: {"view": layouts.route(list(self.views), f.name).name, "dimensions": list(f.dimensions), "measures": [x.name for x in f.measures]} for f in self.contract.families},
        }
