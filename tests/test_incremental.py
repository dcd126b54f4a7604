from pyspark.sql import functions as F

from graphloom.operators.incremental import Manifest, changed_files, digest, newest, pending

SEEN = "repo string, path string, content_hash string, size long, modified_at long, seen_at long"
REC = "repo string, path string, content_hash string, indexed_at long"
RUN = "run_no int, started_at long, ended_at long, status string"


def found(spark, seen, rec, runs):
    out = changed_files(spark.createDataFrame(seen, SEEN), spark.createDataFrame(rec, REC), spark.createDataFrame(runs, RUN))
    return {(r["repo"], r["path"]): r["state"] for r in out.collect()}


def test_newest_ok_record_decides(spark):
    runs = [(1, 100, 150, "ok"), (2, 200, None, None), (3, 300, 350, "failed"), (4, 400, 450, "ok")]
    seen = [("r", "a", "AA", 1, 1, 50), ("r", "a", "sha256:BB", None, None, 90), ("r", "b", "cc", 1, 1, 90), ("r", "c", "dd", 1, 1, 90), ("r", "d", "ee", 1, 1, 90), ("r", "d", "ee", 1, 1, 90)]
    rec = [("r", "a", "bb", 120), ("r", "a", "aa", 320), ("r", "b", "xx", 199), ("r", "b", "cc", 250), ("r", "c", "dd", 99), ("r", "d", "zz", 100), ("r", "d", "ee", 9_999_999_999)]
    assert found(spark, seen, rec, runs) == {("r", "b"): "changed", ("r", "c"): "new"}


def test_nulls_ties_and_empty(spark):
    assert found(spark, [], [], []) == {}
    seen = [(None, "a", "aa", 1, 1, 5), ("r", None, None, 1, 1, 5), ("r", "t", "aa", 1, 1, 5), ("r", "t", "bb", 1, 1, 5)]
    rec = [(None, "a", "aa", 1), ("r", None, None, 1), ("r", "t", "bb", 1)]
    assert found(spark, seen, rec, [(1, 0, None, "ok")]) == {("r", None): "changed"}


def test_digest(spark):
    df = spark.createDataFrame([(" SHA256:AbC ",), ("abc",)], "h string")
    assert {r[0] for r in df.select(digest(F.col("h"))).collect()} == {"abc"}


def test_manifest_survives_failure(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "path string not null, digest string, size long, at long")
    m = Manifest(spark, f"{tmp_path}/m", ["path"])
    first = listing([("a", "1", 1, 1), ("b", "1", 1, 1)])
    ok = lambda df: df.withColumn("x", F.lit(1))

    def fails(df):
        df.count()
        raise RuntimeError("lost")

    try:
        m.run("b1", first, fails, f"{tmp_path}/out")
    except RuntimeError:
        pass
    assert m.entries(first).count() == 0
    assert m.run("b1", first, ok, f"{tmp_path}/out")
    assert not m.run("b1", first, ok, f"{tmp_path}/out")
    second = listing([("a", "2", 1, 2), ("b", "1", 1, 2), ("c", "1", 1, 2)])
    assert m.run("b2", second, ok, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["path"], r["digest"]) for r in out.collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
    assert pending(newest(second.withColumnRenamed("digest", "h"), ["path"], "h", "at"), m.entries(first), ["path"]).count() == 0


def test_a_crash_before_the_commit_repeats_nothing_under_a_new_id(spark, tmp_path, monkeypatch):
    listing = spark.createDataFrame([("a", "1", 1, 1), (None, "1", 1, 1)], "path string, digest string, size long, at long")
    m, out = Manifest(spark, f"{tmp_path}/m", ["path"]), f"{tmp_path}/out"
    fs = m._fs

    class NoRename:
        def __getattr__(self, name):
            return (lambda *_: False) if name == "rename" else getattr(fs, name)

    m._fs = NoRename()
    try:
        m.run("b1", listing, lambda df: df, out)
        raise AssertionError("committed")
    except RuntimeError:
        pass
    m._fs = fs
    assert m.output(out) is None and m.entries(listing).count() == 0
    assert m.run("b2", listing, lambda df: df, out)
    assert {(r["path"], r["batch_id"]) for r in m.output(out).collect()} == {("a", "b2"), (None, "b2")}
    assert spark.read.parquet(out).count() == 2
    sized = spark.createDataFrame([("a", "1", 2, 2), (None, "1", None, 2)], listing.schema)
    assert [r["path"] for r in pending(sized, m.entries(listing), ["path"], "size").collect()] == ["a"]


def test_what_is_processed_is_what_is_committed(spark, tmp_path):
    """The listing may change while a run reads it: it is read once."""
    schema = "path string, digest string, size long, at long"
    src = f"{tmp_path}/src"
    spark.createDataFrame([("a", "1", 1, 1)], schema).write.parquet(src)
    m = Manifest(spark, f"{tmp_path}/m", ["path"])

    def process(df):
        spark.createDataFrame([("a", "2", 1, 2), ("b", "1", 1, 2)], schema).write.mode("append").parquet(src)
        return df

    listing = spark.read.schema(schema).parquet(src)
    assert m.run("b1", listing, process, f"{tmp_path}/out")
    assert [tuple(r) for r in m.entries(listing).select("path", "digest").collect()] == [("a", "1")]
    assert [r["digest"] for r in m.output(f"{tmp_path}/out").collect()] == ["1"]
