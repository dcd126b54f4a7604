"""Processing only new or changed records: a manifest of what was processed, and batches that may be repeated.

Each run lists its input, takes the newest sighting of every key, removes by anti-join what the manifest already holds
with the same checksum and size, writes what it is to do, then its output under the batch's identifier, and commits the
manifest entry last, by a rename. What was processed is what the entry says, as both are read from the one written list.
Whatever a failed run left does not count: readers take the output of committed batches only (``output``), and the next
run clears it away before it starts. So nothing is skipped and nothing is done twice, also if the next run has another
identifier. One run writes at a time.

Defined cases: null keys compare equal to null; a null checksum never equals another, so such a record stays pending; a
size that is not known on both sides says nothing; among sightings of one moment the greatest checksum counts; repeated
rows are one record; an empty listing has nothing pending; checksums are compared as digests (case, blanks and an
``algorithm:`` prefix do not matter).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width in milliseconds of the bins that turn the interval join of records and runs into an equi-join.
BIN_MS = 6 * 3600 * 1000


def digest(c: Column) -> Column:
    """A checksum without the liberties of its spelling."""
    return F.lower(F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9_-]*:\s*", ""))


def newest(rows: DataFrame, keys: Sequence[str], checksum: str, at: str, *more: str) -> DataFrame:
    """The newest row of each key: ``keys, digest, at, *more``; one aggregation with map-side combining."""
    part = rows.select(*keys, F.struct(F.col(at).alias("at"), digest(F.col(checksum)).alias("digest"), *more).alias("_s"))
    top = part.groupBy(*keys).agg(F.max("_s").alias("_s"))
    return top.select(*keys, F.col("_s.digest").alias("digest"), F.col("_s.at").alias("at"), *[F.col(f"_s.{m}").alias(m) for m in more])


def records_of_runs(records: DataFrame, runs: DataFrame, at: str, status: str = "ok") -> DataFrame:
    """The records that runs of the status wrote: those whose ``at`` lies from a run's start up to the next run's.

    Interval join by bins: a run is listed once for each bin that it touches, the last run up to the newest record.
    """
    from pyspark.sql import Window as W

    # A run log has one row for each run and is ordered as a whole; the records are not touched here.
    order = W.orderBy("started_at", F.col("run_no").asc_nulls_last())
    last = records.agg(F.max(at).alias("newest"))
    spans = runs.filter(F.col("started_at").isNotNull()).select("status", F.col("started_at").alias("_from"), F.lead("started_at").over(order).alias("_to"))
    spans = spans.filter(F.col("status") == status).crossJoin(F.broadcast(last))  # one row
    spans = spans.withColumn("_to", F.coalesce("_to", F.col("newest") + 1)).filter(F.col("_to") > F.col("_from"))
    bins = spans.select("_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / BIN_MS), F.floor((F.col("_to") - 1) / BIN_MS))).alias("_bin"))
    rows = records.withColumn("_bin", F.floor(F.col(at) / BIN_MS))
    return rows.join(bins, (rows["_bin"] == bins["_bin"]) & (rows[at] >= bins["_from"]) & (rows[at] < bins["_to"]), "left_semi").drop("_bin")


def pending(listing: DataFrame, manifest: DataFrame, keys: Sequence[str], size: str | None = None) -> DataFrame:
    """Rows of ``listing`` (``keys, digest``) that the manifest does not hold with the same digest, and with the same size
    if a column for it is named."""
    m = manifest.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.col("digest").alias("_m_digest"), *([F.col(size).alias("_m_size")] if size else []))
    same = F.col("digest") == F.col("_m_digest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    if size:
        same = same & F.coalesce(F.col(size) == F.col("_m_size"), F.lit(True))
    return listing.join(m, same, "left_anti")


class Manifest:
    """The committed batches below a folder: ``<path>/batch_id=<id>/`` with ``keys, digest, size, at``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self, folder: str) -> set[str]:
        found = self._fs.globStatus(self._Path(f"{folder.rstrip('/')}/batch_id=*")) or []
        return {f.getPath().getName().removeprefix("batch_id=") for f in found}

    def committed(self, batch_id: str) -> bool:
        return batch_id in self._batches(self.path)

    def entries(self, schema_of: DataFrame) -> DataFrame:
        """The newest committed entry of each key."""
        schema = schema_of.select(*self.keys, "digest", "size", "at").schema
        if not self._batches(self.path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/batch_id=*")
        top = rows.groupBy(*self.keys).agg(F.max(F.struct("at", "digest", "size")).alias("_s"))
        return top.select(*self.keys, "_s.digest", "_s.size", "_s.at")

    def output(self, output: str) -> DataFrame | None:
        """What committed batches wrote, with ``batch_id``; None before the first."""
        done = sorted(self._batches(self.path) & self._batches(output))
        return self.spark.read.option("basePath", output).parquet(*[f"{output.rstrip('/')}/batch_id={b}" for b in done]) if done else None

    def clear(self, output: str) -> None:
        """Remove what runs left that did not commit."""
        for f in self._fs.globStatus(self._Path(f"{self.path}/_staged_*")) or []:
            self._fs.delete(f.getPath(), True)
        fs = self._Path(output).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in self._batches(output) - self._batches(self.path):
            fs.delete(self._Path(f"{output.rstrip('/')}/batch_id={b}"), True)

    def run(self, batch_id: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame], output: str) -> bool:
        """Process what is new in ``listing`` (``keys, digest, size, at, ...``, one row a key) into
        ``<output>/batch_id=<id>``; False if the batch is committed already."""
        if self.committed(batch_id):
            return False
        self.clear(output)
        staged = f"{self.path}/_staged_{batch_id}"
        pending(listing, self.entries(listing), self.keys, "size").write.mode("overwrite").parquet(f"{staged}/todo")
        todo = self.spark.read.schema(listing.schema).parquet(f"{staged}/todo")
        process(todo).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={batch_id}")
        todo.select(*self.keys, "digest", "size", "at").write.mode("overwrite").parquet(f"{staged}/entry")
        if not self._fs.rename(self._Path(f"{staged}/entry"), self._Path(f"{self.path}/batch_id={batch_id}")):
            raise RuntimeError(f"batch {batch_id} could not be committed")
        self._fs.delete(self._Path(staged), True)
        return True


def recorded(records: DataFrame, runs: DataFrame) -> DataFrame:
    """The manifest that the record table amounts to: for each file the newest entry written by a successful run."""
    return newest(records_of_runs(records, runs, "indexed_at"), ("repo", "path"), "content_hash", "indexed_at")


def changed_files(sightings: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """``repo, path, digest, at, size, state``: files whose newest sighting is not what a successful run recorded last."""
    keys = ("repo", "path")
    seen = newest(sightings, keys, "content_hash", "seen_at", "size")
    done = recorded(records, runs)
    todo = pending(seen, done, keys)
    known = done.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.lit(True).alias("_known"))
    out = todo.join(known, todo["repo"].eqNullSafe(known["_r"]) & todo["path"].eqNullSafe(known["_p"]), "left")
    return out.select(*keys, "digest", "at", "size", F.when(F.col("_known"), "changed").otherwise("new").alias("state"))
