"""Problem 8: sources mixed to target shares of the tokens, by Pareto order sampling.

The total is the largest at which no source must repeat a text more often than allowed (or a given one, if smaller).
Each text of a source is due ``e`` copies, in proportion to its weight (one divided by the number of texts equal to it,
so that copies together count as one text). Its whole copies are certain; for the rest, texts are ranked by random odds
divided by the odds of their inclusion probability, and the first are taken until the source's tokens are met.

The cut is found exactly without a global sort: tokens are summed in fine bins of the rank, and in the bin of the cut in
finer ones; only those sums (sources × ``BINS`` numbers) reach the driver, and just the finer bin of the cut is ordered.
Sums are of whole numbers, so the cut does not depend on partitions.

Defined cases: null and empty texts have no tokens and are not mixed; rows of a null or unlisted source are left out;
a listed source without tokens is reported with share 0 and the others keep their proportions; ties of the rank go by id;
random numbers come from id and seed alone, so repeated runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import VOCABULARY, with_token_count

BINS = 4096
MAX_SOURCES = 10_000


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens, copies`` of the texts taken."""
    spark = docs.sparkSession
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.limit(MAX_SOURCES + 1).collect()}
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    part = part.filter(F.col("source").isin([s for s in wanted if s is not None]))
    sized = with_token_count(part, "text", "n_tokens", vocabulary).select("doc_id", "source", "n_tokens", F.md5("text").alias("_key")).filter("n_tokens > 0")
    sized = checkpoint(sized)
    same = sized.groupBy("source", "_key").agg(F.count(F.lit(1)).alias("_same"))
    # equal texts have equal sizes: together they weigh what one of them does
    sums = {r["source"]: float(r["ws"]) for r in sized.groupBy("source", "_key").agg(F.max("n_tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("ws")).collect()}
    sized = sized.join(same, ["source", "_key"]).withColumn("w", 1 / F.col("_same")).drop("_key", "_same")
    shares = {s: wanted[s][0] for s in sums if (wanted[s][0] or 0) > 0 and (wanted[s][1] or 0) > 0}
    schema = "source string, due double, target double"
    if not shares:
        return sized.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).limit(0)
    scale = sum(shares.values())
    most = min(wanted[s][1] * sums[s] * scale / shares[s] for s in shares)
    whole = min(most, total) if total else most
    plan = [(s, whole * shares[s] / scale / sums[s], whole * shares[s] / scale) for s in shares]
    plan_df = spark.createDataFrame(plan, schema)
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    e = F.col("due") * F.col("w")
    due = sized.join(F.broadcast(plan_df), "source").withColumn("_sure", F.floor(e + 1e-9)).withColumn("_pi", F.greatest(F.lit(0.0), e - F.col("_sure")))
    rank = F.when(F.col("_pi") > 1e-9, F.log(u / (1 - u)) - F.log(F.col("_pi") / (1 - F.col("_pi"))))
    due = due.withColumn("_q", rank).withColumn("_bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("_q") + 24) * (BINS / 48))))).select("doc_id", "source", "n_tokens", "target", "_sure", "_q", "_bin")
    due = checkpoint(due)
    sure = {r["source"]: r["t"] for r in due.groupBy("source").agg(F.sum(F.col("_sure") * F.col("n_tokens")).alias("t")).collect()}
    ranked = due.filter("_q IS NOT NULL")
    left = {s: target - sure.get(s, 0) for s, _, target in plan}
    cuts = _cuts(ranked, "_bin", left)
    # the bin of the cut once more, in bins of its own
    fine = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(((F.col("_q") + 24) * (BINS / 48) - F.col("_bin")) * BINS))).cast("int")
    due = due.join(F.broadcast(_table(spark, cuts, "_cut")), "source").withColumn("_fine", F.when(F.col("_bin") == F.col("_cut"), fine))
    finer = _cuts(due.filter("_q IS NOT NULL AND _bin = _cut"), "_fine", {s: r for s, (_, r) in cuts.items()})
    due = due.drop("_left").join(F.broadcast(_table(spark, finer, "_cut2")), "source")
    # Only the finer bin of the cut is ordered: about one in BINS * BINS of a source's texts.
    here = F.coalesce(F.col("_q").isNotNull() & (F.col("_bin") == F.col("_cut")) & (F.col("_fine") == F.col("_cut2")), F.lit(False))
    below = F.col("_q").isNotNull() & ((F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & (F.col("_fine") < F.col("_cut2"))))
    edge = due.filter(here)
    run = F.sum("n_tokens").over(W.partitionBy("source").orderBy("_q", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("_run", run).withColumn("_extra", (F.col("_run") - F.col("n_tokens") / 2 <= F.col("_left")).cast("int"))
    rest = due.filter(~here).withColumn("_extra", F.coalesce(below, F.lit(False)).cast("int"))
    out = rest.select("doc_id", "source", "n_tokens", "_sure", "_extra").unionByName(edge.select("doc_id", "source", "n_tokens", "_sure", "_extra"))
    return out.withColumn("copies", (F.col("_sure") + F.col("_extra")).cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def _cuts(rows: DataFrame, bin_col: str, left: dict[str, float]) -> dict[str, tuple[int, float]]:
    """For each source the bin in which its tokens are met, and how many are then still missing."""
    bins: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("source", bin_col).agg(F.sum("n_tokens").alias("t")).collect():
        bins.setdefault(r["source"], {})[r[bin_col]] = r["t"]
    out = {}
    for s, want in left.items():
        cut, before = BINS, 0
        for b in sorted(bins.get(s, {})):
            if before + bins[s][b] >= want:
                cut = b
                break
            before += bins[s][b]
        out[s] = cut, float(want - before)
    return out


def _table(spark, cuts: dict[str, tuple[int, float]], name: str) -> DataFrame:
    return spark.createDataFrame([(s, c, r) for s, (c, r) in cuts.items()], f"source string, {name} int, _left double")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, texts, most_copies`` for each listed source."""
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    whole = per.agg(F.sum("tokens").alias("_all"))
    out = targets.select("source", "target_share", "max_repeats").join(F.broadcast(per), "source", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
