"""Integrity of an archive, its invariants, and equality with its source."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import archive as archives
from . import query
from .errors import CorruptArchive, VerificationMismatch
from .files import Store, shared_dir, written
from .operators import dictionary, state, tiers
from .plans import layout as layouts
from .plans.contract import Measure


def broken_state(measures: tuple[Measure, ...] | list[Measure]) -> Column:
    """Whether a cell contradicts itself: counts below zero, least above greatest, bins that don't add up."""
    by = {(m.field, m.op): m for m in measures}
    out = F.lit(False)
    for (field, op), m in by.items():
        c = state.quoted(state.stem(m))
        if op in ("count", "count_present"):
            out |= c < 0
        if op == "count_present" and ("*", "count") in by:
            out |= c > state.quoted("count")
        if op == "min" and (field, "max") in by:
            out |= F.coalesce(c > state.quoted(state.stem(by[field, "max"])), F.lit(False))
        if op in ("min", "max", "sum") and (field, "count_present") in by:
            out |= (state.quoted(state.stem(by[field, "count_present"])) == 0) != c.isNull()
        if op == "histogram" and (field, "count_present") in by:
            out |= sum((state.quoted(b) for b in state.bin_columns(m)), F.lit(0)) != state.quoted(state.stem(by[field, "count_present"]))
    return F.coalesce(out, F.lit(True))


def repeated_keys(view: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    return view.groupBy(state.BUCKET, *[state.quoted(d) for d in dimensions]).agg(F.count("*").alias("n")).where("n > 1")


def unsorted_rows(view: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Rows that don't come after the row before them in their file."""
    keys = [state.BUCKET, *dimensions]
    placed = view.select("*", F.input_file_name().alias("__f"), F.monotonically_increasing_id().alias("__i"))
    w = Window.partitionBy("__f").orderBy("__i")
    before = {f"__b{i}": F.lag(state.quoted(k)).over(w) for i, k in enumerate(keys)}
    placed = placed.withColumns({**before, "__n": F.row_number().over(w)})
    after, same = F.lit(False), F.lit(True)
    for i, k in enumerate(keys):
        now, was = state.quoted(k), F.col(f"__b{i}")
        after |= same & F.coalesce(now > was, was.isNull() & now.isNotNull())
        same &= now.eqNullSafe(was)
    return placed.where((F.col("__n") > 1) & ~after)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with ``side``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def check_files(archive) -> None:
    """Paths, lengths and digests; the digests are computed in tasks."""
    listed, store = archive.manifest["files"], Store(archive.spark, archive.path)
    sizes = store.sizes()
    for name, x in listed.items():
        if posixpath.isabs(name) or posixpath.normpath(name) != name or name.startswith(".."):
            raise CorruptArchive(f"unsafe path {name!r}")
        if sizes.get(name) != x["bytes"]:
            raise CorruptArchive(f"{name} is missing or has another length")
    if extra := set(sizes) - set(listed):
        raise CorruptArchive(f"{sorted(extra)[0]} isn't listed")
    digests = store.digests()
    for name, x in listed.items():
        if digests.get(name) != x["sha256"]:
            raise CorruptArchive(f"{name} was changed")
    if archives.archive_hash(archive.manifest) != archive.manifest["archive_hash"]:
        raise CorruptArchive("the manifest was changed")


def check_views(archive) -> None:
    width = archive.manifest["bucket_ns"]
    for v, listed in zip(archive.views, archive.manifest["views"]):
        table = archive.view(v.name)
        n = table.agg(F.count("*").alias("n"), F.count_if(F.pmod(state.BUCKET, F.lit(width)) != 0).alias("off"), F.count_if(broken_state(v.measures)).alias("bad")).first()
        if n["n"] != listed["rows"]:
            raise CorruptArchive(f"{v.name} has {n['n']} rows, not {listed['rows']}")
        if n["off"] or n["bad"]:
            raise CorruptArchive(f"{v.name} has broken cells")
        if not repeated_keys(table, v.dimensions).isEmpty():
            raise CorruptArchive(f"{v.name} has a key twice")
        if not unsorted_rows(table, v.dimensions).isEmpty():
            raise CorruptArchive(f"{v.name} isn't sorted")


def check_tiers(archive) -> None:
    m, error = archive.manifest, tiers.is_error(archive.contract.retention)
    errors, recent = archive.tier("errors"), archive.tier("recent")
    e = errors.agg(F.count("*").alias("n"), F.count_if(~error).alias("bad")).first()
    r = recent.agg(F.count("*").alias("n"), F.count_if(error | (F.col("timestamp_ns") < m["cutoff_ns"])).alias("bad")).first()
    if e["bad"] or r["bad"]:
        raise CorruptArchive("an event is in the wrong tier")
    if e["n"] != m["tier_counts"]["errors"] or r["n"] != m["tier_counts"]["recent"] or e["n"] != m["error_count"]:
        raise CorruptArchive("a tier has another number of events than the manifest")
    if not errors.join(recent, "event_id", "left_semi").isEmpty():
        raise CorruptArchive("an event is in both tiers")


def verify(archive) -> None:
    """Raises unless files, views, tiers and dictionaries are what they should be."""
    check_files(archive)
    check_views(archive)
    check_tiers(archive)
    for name in archive.manifest["dictionaries"]:
        dictionary.check(archive.dictionary(name))


class _Folded:
    """The cells of a source, folded once for each view of the separate layout, to hold answers against."""

    def __init__(self, events: DataFrame, contract, root: str):
        self.contract, self.views = contract, tuple(layouts.separate(contract))
        self.tables = {v.name: written(state.cells(events, contract.bucket_ns, v.dimensions, v.measures), f"{root}/{v.name}") for v in self.views}

    def view(self, name: str) -> DataFrame:
        return self.tables[name]


def verify_queries(archive, events: DataFrame, specs: list) -> int:
    """Raises unless every request is answered from views as the source answers it; returns how many were compared.

    The source is folded into its finest cells once, and all requests are answered from those together; one
    request a family is also answered by scanning events.
    """
    verify(archive)
    if not specs:
        return 0
    work = Store(archive.spark, f"{shared_dir(archive.spark)}/folded-{uuid.uuid4().hex}")
    try:
        got, want = query.batch(archive, specs), query.batch(_Folded(events, archive.contract, work.root), specs)
        if wrong := difference(got.select(sorted(got.columns)), want.select(sorted(got.columns))).select("query").first():
            raise VerificationMismatch(f"views and source differ: {specs[wrong['query']].to_json()}")
        for spec in {s.family: s for s in specs}.values():
            if not difference(query.from_views(archive, spec), query.from_events(events, archive.contract, spec, order=False)).isEmpty():
                raise VerificationMismatch(f"views and source differ: {spec.to_json()}")
    finally:
        work.delete()
    return len(specs)
