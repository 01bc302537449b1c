"""Files of any store that Spark reaches, through Hadoop's file systems; no path is taken to be on a local disk."""

from __future__ import annotations

import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a folder of its own, and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tierview-"))
    return spark.sparkContext.getCheckpointDir()


class Store:
    """The file system of one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.jvm = spark, root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{self.root}/{name} can't be moved to {to}")

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def sizes(self, name: str = "") -> dict[str, int]:
        """Bytes of the files below a folder that archives list, by name relative to the root."""
        base, found = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/"), {}
        if self.exists(name):
            files = self.fs.listFiles(self._path(name), True)
            while files.hasNext():
                file = files.next()
                at = file.getPath().toUri().getPath()[len(base) + 1 :]
                if at.endswith((".parquet", ".toml")):
                    found[at] = file.getLen()
        return found

    def digests(self) -> dict[str, str]:
        """SHA-256 of each listed file, computed in tasks; (name, digest) is all that is gathered."""
        base = self.fs.makeQualified(self._path("")).toUri().getPath().rstrip("/")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{parquet,toml}").load(self.root)
        rows = files.select("path", F.sha2("content", 256).alias("digest")).collect()
        out = {}
        for r in rows:
            path = self.jvm.org.apache.hadoop.fs.Path(r["path"]).toUri().getPath()
            out[path[len(base) + 1 :]] = r["digest"]
        return out


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, read back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
