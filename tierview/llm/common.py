"""What the operators share: tables cut into the shared folder, and the reading of inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shuffle files of an execution go when it ends: what ``cut`` writes replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tierview-"))
    return spark.sparkContext.getCheckpointDir()


#: Rows that a task of a table with a known number of rows should have, and the fewest tasks.
TASK_ROWS, LEAST_TASKS = 50_000, 12


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows or other units of work, in tasks of about ``each``: never more than before, nor a single one."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // each)))


def cut(df: DataFrame, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors. ``rows``: about how many there are."""
    spark = df.sparkSession
    df = df if rows is None else few(df, rows)
    path = f"{shared_dir(spark)}/tierview/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tierview_cut = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut``, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_tierview_cut", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows that one (key, salt) group should hold at most, and the fewest salts.
GROUP_ROWS, LEAST_SALTS = 1_000_000, 64


def rank_in_group(df: DataFrame, key: str, tie: list[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: 0, 1, ... within each ``key`` (not null), gapless, in order of a hash of ``tie``.

    A key's rows are dealt over salts, ranked inside (key, salt) and offset by the counts of
    earlier salts, so no task needs all rows of a key. Offsets meet rows in a merge join, which deals
    both as the ranking does. ``rows``: about how many rows there are.
    """
    salts = max(LEAST_SALTS, 1 << (rows // GROUP_ROWS).bit_length())
    salted = df.withColumn("__tie", F.xxhash64(*tie)).withColumn("__salt", F.pmod(F.shiftrightunsigned("__tie", 40), F.lit(salts)).cast("int"))
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(key, "__salt").agg(F.count("*").alias("__n"))
    offsets = cut(counts.select(F.col(key).alias("__k"), F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    inside = Window.partitionBy(key, "__salt").orderBy("__tie", *tie)
    joined = salted.join(offsets.hint("merge"), (F.col(key) == F.col("__k")) & (F.col("__salt") == F.col("__s")))
    return joined.withColumn(out, F.row_number().over(inside) - 1 + F.col("__offset")).drop("__k", "__s", "__offset", "__salt", "__tie")
