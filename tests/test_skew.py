import random
from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators.skew import SkewPlan, dominant_keys, plan_shards, results_per_key, skew_join


def rows(seed, n=4000):
    r = random.Random(seed)
    return [(None if r.random() < 0.05 else "hot" if r.random() < 0.4 else f"k{r.randrange(300)}", r.choice(["a", "b", None]), i % 7) for i in range(n)]


def test_results_match_brute_force(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, kind string, v int")
    got = {(r["k"], r["kind"]): (r["n_rows"], r["n_distinct"]) for r in results_per_key(df, ["k", "kind"], "v").collect()}
    n = Counter((a, b) for a, b, _ in data)
    d = Counter((a, b) for a, b, _ in set(data))
    assert got == {k: (n[k], d[k]) for k in n}


def test_hot_keys_are_spread(spark):
    df = spark.createDataFrame([("hot", 1)] * 5000 + [(f"k{i}", 1) for i in range(5000)], "k string, v int")
    plan = SkewPlan(df, ["k"], tasks=8)
    sizes = plan.spread(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 10000 / 8
    assert len(plan.placed[("hot",)]) == 4


def test_join_equals_plain_join(spark):
    data = rows(2)
    a = spark.createDataFrame(data, "k string, kind string, v int")
    b = spark.createDataFrame([("hot", "H", 9), ("hot", "I", 9), (None, "N", 9), ("k1", "1", 9), ("absent", "x", 9)], "k string, name string, v int")
    for how in ("inner", "left", "left_semi"):
        plain = a.alias("a").join(b.select(F.col("k").alias("k2"), "name"), F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
        got = skew_join(a, b, ["k"], how, tasks=8)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.select(got.columns).collect()))


def test_results_do_not_depend_on_the_estimate(spark, monkeypatch):
    from graphloom.operators import skew

    monkeypatch.setattr(skew, "SAMPLE_LEAST", 100)
    monkeypatch.setattr(skew, "SAMPLE_KEY", 1)
    data = rows(3)
    df = spark.createDataFrame(data, "k string, kind string, v int")
    got = results_per_key(df, ["k", "kind"], plan=SkewPlan(df, ["k", "kind"], tasks=16))
    assert {(r["k"], r["kind"]): r["n_rows"] for r in got.collect()} == Counter((a, b) for a, b, _ in data)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and {r["shards"] for r in got.filter("k = 'hot'").collect()} != {1}


def test_plan_packs_evenly():
    placed, slots = plan_shards([(("x",), 700), (("y",), 100)], 1000, 10)
    load = Counter(t for ts in placed.values() for t in ts)
    assert len(placed[("x",)]) == 7 and set(slots) <= set(range(10)) and len(load) == 8


def test_dominant_and_empty(spark):
    df = spark.createDataFrame([("a", None)] * 2 + [(f"k{i}", "x") for i in range(98)], "target string, kind string")
    assert {(r["target"], r["kind"]) for r in dominant_keys(df, ["target", "kind"], 0.02).collect()} == {("a", None)}
    assert dominant_keys(df.limit(0), ["target", "kind"]).count() == 0
