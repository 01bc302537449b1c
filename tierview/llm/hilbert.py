"""Hilbert-curve sharding, with DataFrame functions only.

Several metadata columns are quantised to a few bits each, the cell's place on the Hilbert
curve (Skilling's transform) orders the rows, and the order is cut into runs of equal row
counts. Runs are compact boxes in metadata space, so the per-shard ranges of ``manifest``
let a reader skip files on any of the dimensions.

Ranks are exact without one task ever seeing all rows: a row's rank is the number of rows in
earlier (cell, salt) groups, from a table of counts, plus its number inside its own group. A cell
that holds a third of all rows is dealt over its salts.

Defined cases: null dimensions fall in slot 0; a null text has no bytes and size 1; equal rows
take neighbouring ranks in any order; an empty table gives an empty result; input columns with the names of
results (hilbert_index, shard, slot; shard_id in files) are replaced, all others are carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BITS = 4
#: Rows that one (cell, salt) group should hold at most, and the fewest salts.
GROUP_ROWS, LEAST_SALTS = 1_000_000, 64


def quantise_text(column: str | Column, bits: int = BITS) -> Column:
    """A name's slot without a look at the table: the low bits of its CRC; null takes slot 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("binary")).bitwiseAND((1 << bits) - 1), F.lit(0)).cast("int")


def quantise_frequent(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """A name's slot: the most frequent names have one each, in order of name; all others share the last, and null takes slot 0.

    So a shard's slots say which names it can hold. At most 2**bits - 2 names are read.
    """
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit((1 << bits) - 2)
    slot = F.when(F.col(column).isNull(), 0)
    for i, name in enumerate(sorted(r["name"] for r in top.collect()), 1):
        slot = slot.when(F.col(column) == name, i)
    return slot.otherwise((1 << bits) - 1).cast("int")


def quantise_size(column: Column, bits: int = BITS) -> Column:
    """A size's slot: its number of binary digits, so that each slot spans twice the last."""
    return F.least(F.coalesce(F.length(F.bin(column)), F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def with_hilbert_index(df: DataFrame, dims: dict[str, Column], out: str, bits: int = BITS) -> DataFrame:
    """Adds ``out``: the Hilbert index of the quantised ``dims`` (each 0 .. 2**bits - 1)."""
    names = [f"__h{i}" for i in range(len(dims))]
    df = df.withColumns(dict(zip(names, dims.values())))
    first = F.col(names[0])
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for name in names:
            this = F.col(name)
            on = this.bitwiseAND(bit) != 0
            swap = first.bitwiseXOR(this).bitwiseAND(low)
            if name == names[0]:
                df = df.withColumn(name, F.when(on, this.bitwiseXOR(F.lit(low))).otherwise(this))
            else:
                df = df.withColumns({names[0]: F.when(on, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap)), name: F.when(on, this).otherwise(this.bitwiseXOR(swap))})
    for before, name in zip(names, names[1:]):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.col(before)))
    last = F.col(names[-1])
    flips = reduce(Column.bitwiseXOR, [F.when(last.bitwiseAND(1 << k) != 0, F.lit((1 << k) - 1)).otherwise(F.lit(0)) for k in range(bits - 1, 0, -1)], F.lit(0))
    df = df.withColumn("__flip", flips)
    df = df.withColumns({n: F.col(n).bitwiseXOR(F.col("__flip")) for n in names})
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for name in names:
            index = index * 2 + F.shiftright(F.col(name), level).bitwiseAND(1)
    return df.withColumn(out, index).drop("__flip", *names)


def hilbert_shards(df: DataFrame, dims: dict[str, Column], tie: list[str], n_shards: int, bits: int = BITS) -> DataFrame:
    """``df`` with hilbert_index, shard (0 .. n_shards - 1) and slot (gapless from 0 in each shard).

    Rows are ordered by (index, hash of ``tie``, ``tie``); shards differ by one row at most. Give
    narrow rows: all of ``df`` is shuffled once.
    """
    df = df.drop("hilbert_index", "shard", "slot")
    base = cut(with_hilbert_index(df, dims, "hilbert_index", bits).withColumn("__tie", F.xxhash64(*tie)))
    total = base.count()
    salts = max(LEAST_SALTS, 1 << max(0, (total // GROUP_ROWS).bit_length()))
    salted = base.withColumn("__salt", F.pmod(F.shiftrightunsigned("__tie", 40), F.lit(salts)).cast("int"))
    counts = salted.groupBy("hilbert_index", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("hilbert_index").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("hilbert_index").agg(F.sum("__n").alias("__cell"))
    # One row a cell: 2 ** (bits * dims) rows at most, whatever the input.
    starts = cells.select(F.col("hilbert_index").alias("__i"), F.coalesce(F.sum("__cell").over(Window.orderBy("hilbert_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    offsets = cut(
        counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(starts, F.col("hilbert_index") == F.col("__i"))
        .select("__i", F.col("__salt").alias("__s"), (F.col("__before") + F.col("__start")).alias("__offset"))
    )
    inside = Window.partitionBy("hilbert_index", "__salt").orderBy("__tie", *tie)
    ranked = salted.join(offsets.hint("merge"), (F.col("hilbert_index") == F.col("__i")) & (F.col("__salt") == F.col("__s"))).withColumn("__rank", F.row_number().over(inside) - 1 + F.col("__offset"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((__rank * {n_shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(cast(shard as bigint) * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("slot", F.col("__rank") - first).drop("__i", "__s", "__offset", "__rank", "__salt", "__tie")


def manifest(shards: DataFrame, columns: list[str], slots: list[str] | None = None) -> DataFrame:
    """Per shard: rows, least and greatest of each of ``columns``, and the set of each of ``slots`` (quantised, so small), for skipping files."""
    ends = [f(c).alias(f"{how}_{c}") for c in columns for how, f in (("min", F.min), ("max", F.max))]
    return shards.groupBy("shard").agg(F.count("*").alias("rows"), *ends, *[F.sort_array(F.collect_set(c)).alias(f"set_{c}") for c in slots or []])


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Writes ``df`` in curve order, a folder a shard; ``assigned`` has the unique ``key``, shard and slot."""
    placed = df.drop("shard_id").join(assigned.select(F.col(key).alias("__k"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot")), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    placed.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot").withColumn("shard_id", F.col("__shard")).drop("__shard", "__slot").write.partitionBy("shard_id").parquet(path)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id", "lang", "source",
        (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    dims = {"lang": quantise_frequent(docs, "lang"), "source": quantise_frequent(docs, "source"), "size": quantise_size(F.col("size"))}
    out = hilbert_shards(rows, dims, ["doc_id", "text_crc32", "size"], 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert_index")
