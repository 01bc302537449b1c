"""Dictionaries of dimension values: ids by byte order, null being 0."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CorruptArchive, InputError
from ..files import shared_dir, written
from .state import dimension


def values(events: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Distinct values of a dimension, null first, by bytes."""
    found = events.select(dimension(name).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
    return found if limit is None else found.limit(limit)


def build(events: DataFrame, name: str) -> DataFrame:
    """(id, value): null is 0 whether or not it occurs, values follow from 1.

    Distinct values only are numbered: ranges of values, cut by a sample, are sorted apart and numbered from the
    counts of the ranges before, so no task orders them all, whatever prefixes they share.
    """
    found = events.select(dimension(name).alias("value")).where(F.col("value").isNotNull()).distinct()
    ranged = found.repartitionByRange("value").withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, f"{shared_dir(events.sparkSession)}/dictionary-{uuid.uuid4().hex}")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row a partition.
    before = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("value"))
    numbered = ranged.join(before, F.col("__part") == F.col("__p")).select((F.col("__before") + inside).cast("long").alias("id"), "value")
    null = events.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("value"))
    return null.unionByName(numbered)


def encode(events: DataFrame, name: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Adds the id of each value. Spark broadcasts the dictionary only if it is small."""
    d = dictionary.select(F.col("id").alias(out), F.col("value").alias("__value"))
    return events.join(d, dimension(name).eqNullSafe(F.col("__value")), "left").drop("__value")


def decode(table: DataFrame, id_column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Adds the value of each id; an id outside the dictionary raises."""
    d = dictionary.select(F.col("id").alias("__id"), F.col("value").alias(out), F.lit(True).alias("__there"))
    joined = table.join(d, table[id_column] == F.col("__id"), "left")
    checked = F.when(F.col("__there"), F.col(out)).otherwise(F.raise_error(F.concat(F.lit("id outside the dictionary: "), F.coalesce(F.col(id_column).cast("string"), F.lit("null")))))
    return joined.withColumn(out, checked).drop("__id", "__there")


def cardinality(events: DataFrame, names: list[str]) -> DataFrame:
    """(dimension, values): exact distinct values, null counted as one more."""
    parts = [events.select(F.lit(n).alias("dimension"), dimension(n).alias("value")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().groupBy("dimension").agg((F.count("value") + 1).alias("values"))


def check_ceiling(events: DataFrame, names: list[str], ceiling: int) -> None:
    if names and (over := cardinality(events, names).where(F.col("values") > ceiling).orderBy("dimension").first()):
        raise InputError(f"{over['dimension']} has {over['values']} values; the limit is {ceiling}")


def check(dictionary: DataFrame) -> None:
    """Null first and alone, ids gapless, values rising by bytes."""
    n = dictionary.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("ids"), F.count_if((F.col("id") == 0) != F.col("value").isNull()).alias("odd")).first()
    if n["odd"] or n["low"] != 0 or n["high"] != n["n"] - 1 or n["ids"] != n["n"]:
        raise CorruptArchive("a dictionary's ids are broken")
    twin = dictionary.select((F.col("id") + 1).alias("id"), F.col("value").alias("before"))
    if not dictionary.join(twin, "id").where(F.col("before") >= F.col("value")).isEmpty():
        raise CorruptArchive("a dictionary isn't sorted")
