"""Streams: file changes into the graph, debounced change events, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import store
from ..sources.extract import extract


def detect_changes(listing: DataFrame, files: DataFrame) -> DataFrame:
    """``path, change`` of a listing (``path, content_hash, modified_at``) against file records: unchanged if known and
    not modified since it was indexed, else by hash; ``removed`` if no longer listed."""
    f = store.current_files(files).select(F.col("path").alias("_p"), F.col("content_hash").alias("_h"), F.col("indexed_at").alias("_i"))
    both = listing.select("path", "content_hash", "modified_at").join(f, F.col("path") == F.col("_p"), "full")
    change = (
        F.when(F.col("path").isNull(), "removed").when(F.col("_p").isNull(), "added").when(F.col("modified_at") <= F.col("_i"), "unchanged").when(F.col("content_hash") == F.col("_h"), "unchanged").otherwise("changed")
    )
    return both.select(F.coalesce("path", "_p").alias("path"), change.alias("change"))


def debounce(events: DataFrame, gap: str = "2 seconds", delay: str = "10 seconds", key: str = "path", at: str = "ts") -> DataFrame:
    """One row for each burst of events of a key: a burst ends when nothing came for ``gap``. Works on streams (append
    mode, late events beyond ``delay`` are dropped) and tables alike."""
    src = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.session_window(F.col(at), gap)
    return src.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type."""
    src = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return src.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("began"), "event_type", "n", "total")


def sync_batch(graph: store.Graph, changed: DataFrame, removed: DataFrame) -> store.Graph:
    """The graph after a batch of files: ``changed`` has ``repo, path, text, content_hash, language, size, modified_at,
    indexed_at``, ``removed`` has ``path``. Nodes, edges and refs of all touched files are replaced in a few set
    operations; edges from untouched files are kept where the new symbol has the old one's name and kind."""
    x = extract(changed.select("path", "text"))
    touched = changed.select("path").union(removed.select("path")).distinct()
    old = graph.nodes.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    gone = old.select("id")
    new_nodes = x.nodes.withColumn("updated_at", F.lit(0).cast("long"))
    for c in graph.nodes.columns:
        if c not in new_nodes.columns:
            new_nodes = new_nodes.withColumn(c, F.lit(None).cast(graph.nodes.schema[c].dataType))
    nodes = graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns).unionByName(new_nodes.select(*graph.nodes.columns))
    kept = graph.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti")
    first = new_nodes.groupBy("name", "kind").agg(F.min(F.struct("start_line", "id")).alias("s")).select("name", "kind", F.col("s.id").alias("new_target"))
    moved = old.select(F.col("id").alias("target"), F.col("name"), F.col("kind").alias("t_kind")).join(first.withColumnRenamed("kind", "t_kind"), ["name", "t_kind"]).select("target", "new_target")
    lost = gone.withColumnRenamed("id", "target")
    stay = kept.join(lost, "target", "left_anti").select(*graph.edges.columns)
    back = kept.join(moved, "target").withColumn("target", F.col("new_target")).select(*graph.edges.columns)
    own = x.edges.select("source", "target", "kind", F.lit(None).cast("string").alias("metadata"), "line", F.lit(None).cast("int").alias("column_no"), F.lit("parser").alias("provenance"))
    edges = store.insert_edges(stay.unionByName(back).unionByName(own), nodes)
    refs = graph.refs.join(touched.withColumnRenamed("path", "file_path"), "file_path", "left_anti").select(*graph.refs.columns)
    raised = x.refs.select("from_node_id", "reference_name", "reference_kind", "line", "column_no", F.array().cast("array<string>").alias("candidates"), "file_path", "language", F.lit("pending").alias("status"), F.element_at(F.split("reference_name", r"\."), -1).alias("name_tail"))
    counts = x.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    record = changed.join(counts, "path", "left").select("repo", "path", "content_hash", "language", "size", "modified_at", "indexed_at", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.array().cast("array<string>").alias("errors"))
    files = graph.files.join(touched, "path", "left_anti").select(*graph.files.columns).unionByName(record.select(*graph.files.columns))
    return store.Graph(nodes, edges.select(*graph.edges.columns), refs.unionByName(raised.select(*graph.refs.columns)), files)


def sync_stream(spark: SparkSession, changes: DataFrame, at: store.Store, checkpoint: str, trigger: dict | None = None, after: Callable[[store.Graph, int], None] | None = None) -> StreamingQuery:
    """Keeps the store up to date with a stream of file versions. A batch is applied to the snapshot before it and the
    manifest names the batch, so a repeated batch changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        if int(at.meta().get("batch", -1)) >= number:
            return
        newest = batch.groupBy("path").agg(F.max(F.struct("modified_at", *[c for c in batch.columns if c not in ("path", "modified_at")])).alias("s"))
        flat = newest.select("path", "s.*")
        graph = sync_batch(at.load(), flat.filter("text IS NOT NULL"), flat.filter("text IS NULL").select("path"))
        at.save(graph, batch=str(number))
        if after:
            after(graph, number)

    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
