"""What every operator needs of the session: the package on the workers, tables, and cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Give the workers this package; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        path = Path(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
        sc.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share. A local one only where none is named and the master is local,
    as in tests; on a cluster the name is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "graphloom-checkpoints")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Levels:
    """The tables of a loop's rounds below one shared folder, apart by the flag column ``kept``; one written table each."""

    def __init__(self, spark: SparkSession, columns: str, kept: str):
        self.spark, self.columns, self.kept, self.n, self.path = spark, columns, kept, -1, shared_dir(spark)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"{self.columns}, level int, {self.kept} boolean").option("basePath", self.path).parquet(path)

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Write the next level; None if it has no rows."""
        self.n += 1
        path = f"{self.path}/level={self.n}"
        rows.hint("rebalance").write.partitionBy(self.kept).parquet(path)
        return self._read(path) if any(path_exists(self.spark, f"{path}/{self.kept}={flag}") for flag in ("true", "false")) else None

    def all(self) -> DataFrame:
        return self._read(self.path)


def widen(df: DataFrame) -> DataFrame:
    """The rows over all cores if a small input came in fewer partitions; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def drop_checkpoint(*frames: DataFrame) -> None:
    """Delete written tables that no later job reads."""
    for df in frames:
        for f in {os.path.dirname(p) for p in df.inputFiles()}:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
