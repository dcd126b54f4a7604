"""Search: weighted BM25 over four fields, name tiers, exact names, vectors, rank fusion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import camel_words

FIELDS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
K1, B = 1.2, 0.75
RRF_K, PER_SIGNAL = 60, 50


def postings(nodes: DataFrame) -> DataFrame:
    """``field, term, id, tf, length``: the inverted index, one row for each term of each field of each node."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), camel_words(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in FIELDS])
    one = nodes.select("id", F.explode(fields).alias("f")).select("id", "f.field", F.size("f.words").alias("length"), F.explode("f.words").alias("term"))
    return one.groupBy("field", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def field_lengths(nodes: DataFrame) -> DataFrame:
    """``field, docs, mean_length`` over all nodes; nodes without the field do not count."""
    sizes = nodes.select(*[F.size(camel_words(F.coalesce(F.col(f), F.lit("")))).alias(f) for f in FIELDS])
    row = sizes.agg(*[F.sum((F.col(f) > 0).cast("long")).alias(f"{f}_n") for f in FIELDS], *[F.sum(f).alias(f"{f}_t") for f in FIELDS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("docs"), (F.col(f"{f}_t") / F.greatest(F.col(f"{f}_n"), F.lit(1))).alias("mean_length")) for f in FIELDS])).alias("s")).select("s.*")


def search_fts(nodes: DataFrame, query: str, limit: int = 20, offset: int = 0, kinds: Iterable[str] = (), languages: Iterable[str] = (), match_all: bool = True, index: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """``id, name, score``: weighted BM25. A field counts if it holds every term (or any, with ``match_all`` off); a
    node counts if any field does. Statistics are those of all nodes; filters come after."""
    spark = nodes.sparkSession
    terms = spark.range(1).select(F.array_distinct(camel_words(F.lit(query))).alias("t")).first()["t"]
    if not terms:
        return nodes.select("id", "name", F.lit(0.0).alias("score")).limit(0)
    # Only the query's terms leave the scan of the index.
    index = (postings(nodes) if index is None else index).filter(F.col("term").isin(*terms))
    lengths = field_lengths(nodes) if lengths is None else lengths
    df = index.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    hit = index.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(lengths), "field")  # terms x 4 rows, 4 rows
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    weight = F.create_map(*[x for f, w in FIELDS.items() for x in (F.lit(f), F.lit(w))])[F.col("field")]
    per = hit.groupBy("id", "field").agg(F.sum(idf * tf * weight).alias("s"), F.count(F.lit(1)).alias("n"))
    if match_all:
        per = per.filter(F.col("n") == len(terms))
    scores = per.groupBy("id").agg(F.sum("s").alias("score"))
    out = _filtered(nodes, kinds, languages).select("id", "name").join(scores, "id")
    return out.orderBy(F.desc(F.round("score", 9)), "id").offset(offset).limit(limit)


def _filtered(nodes: DataFrame, kinds: Iterable[str], languages: Iterable[str]) -> DataFrame:
    if kinds:
        nodes = nodes.filter(F.col("kind").isin(*kinds))
    return nodes.filter(F.col("language").isin(*languages)) if languages else nodes


def search_name_like(nodes: DataFrame, query: str, limit: int = 20, kinds: Iterable[str] = (), languages: Iterable[str] = ()) -> DataFrame:
    """``id, name, score``: exact name 1, same but for case .9, prefix .8, inside .7, inside the qualified name .5;
    shorter names (in bytes) first."""
    q, low = query.lower(), F.lower("name")
    tier = F.when(F.col("name") == query, 1.0).when(low == q, 0.9).when(low.startswith(q), 0.8).when(low.contains(q), 0.7).when(F.lower("qualified_name").contains(q), 0.5)
    hit = _filtered(nodes, kinds, languages).filter(low.contains(q) | F.lower("qualified_name").contains(q))
    return hit.select("id", "name", tier.alias("score")).orderBy(F.desc("score"), F.octet_length("name"), "name", "id").limit(limit)


def find_by_exact_names(nodes: DataFrame, names: Sequence[str], per_name: int = 50) -> DataFrame:
    """``asked, id, name``: at most ``per_name`` nodes for each name, whatever its case."""
    asked = nodes.sparkSession.createDataFrame([(n.lower(),) for n in sorted(set(names))], "asked string")
    hit = nodes.select(F.lower("name").alias("asked"), "id", "name").join(F.broadcast(asked), "asked")
    return hit.withColumn("_n", F.row_number().over(W.partitionBy("asked").orderBy("id"))).filter(F.col("_n") <= per_name).drop("_n")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(vectors: DataFrame, query: Sequence[float], limit: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, score``: exact cosine neighbours of one vector, score 1 / (1 + distance); the top is kept in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = 1 - cosine(F.col(vec_col), q)
    return vectors.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), F.round(1 / (1 + d), 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def vector_neighbours(vectors: DataFrame, every: int = 20, k: int = 10, block: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank``: exact neighbours of every ``every``-th vector against all vectors.

    Queries are cut into blocks; each task multiplies its batches with each block and keeps its own k best, so a vector
    is read once for each block and nothing but k rows a query and task is shuffled.
    """
    import numpy as np
    import pandas as pd

    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(F.col("v").isNotNull())
    queries = clean.filter(F.col("id") % every == 0)
    tagged = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(1))))
    n = queries.count()
    blocks = max(1, -(-n // block))
    tagged = queries.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    shards = max(1, clean.rdd.getNumPartitions())
    left = tagged.groupBy("_b").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))  # about ``block`` each
    left = left.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = clean.withColumn("_s", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int"))

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        m = np.array(b["v"].tolist(), dtype=np.float64) if len(b) else np.empty((0, 1))
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids = b["id"].to_numpy()
        for qi, qv in zip(a["ids"], a["vs"]):
            if not len(m):
                continue
            q = np.array(list(map(list, qv)), dtype=np.float64)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            s = q @ m.T
            for i, one in zip(qi, s):
                order = np.lexsort((ids, -np.round(one, 9)))
                order = [j for j in order[: k + 1] if ids[j] != i][:k]
                out += [(int(i), int(ids[j]), float(one[j])) for j in order]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    top = left.groupBy("_s").cogroup(right.groupBy("_s")).applyInPandas(best, "query_id long, id long, similarity double")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id"))
    return top.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def reciprocal_rank_fusion(*signals: DataFrame, k: int = RRF_K) -> DataFrame:
    """``id, score`` from lists ``id, rank`` with ranks from 0."""
    both = signals[0].select("id", "rank")
    for s in signals[1:]:
        both = both.unionByName(s.select("id", "rank"))
    return both.groupBy("id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "id")


def ranked(hits: DataFrame, n: int = PER_SIGNAL) -> DataFrame:
    """The first ``n`` of a result list with ranks from 0."""
    order = W.orderBy(F.desc(F.round("score", 9)), "id")
    return hits.orderBy(F.desc(F.round("score", 9)), "id").limit(n).select("id", (F.row_number().over(order) - 1).alias("rank"))


def embedding_text(nodes: DataFrame) -> DataFrame:
    """``id, text`` to embed; files, imports, exports and parameters are left out."""
    own = nodes.filter(~F.col("kind").isin("file", "import", "export", "parameter"))
    return own.select("id", F.concat_ws(" ", "name", "qualified_name", "signature", "docstring").alias("text"))


def embed(nodes: DataFrame, model) -> DataFrame:
    """``id, embedding`` by a caller's model: a function from a list of texts to a list of vectors."""
    import pandas as pd

    def run(parts):
        for p in parts:
            yield pd.DataFrame({"id": p["id"], "embedding": list(model(p["text"].tolist()))})

    return embedding_text(nodes).mapInPandas(run, "id string, embedding array<float>")
