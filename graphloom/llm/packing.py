"""Problem 7: texts in packs of fixed capacity, by harmonic packing.

A text longer than the capacity is cut into full packs and a rest; nothing else is split. Sizes fall into reciprocal
classes: class j holds sizes in (C/(j+1), C/j], so any j of them fit one pack, whatever they are; a pack of class j gets
just j. Workers pack hash buckets of items on their own; the number of buckets depends on the number of items alone.
Where this goes beyond the plain method: the room that the packs of larger classes leave, also the last one of a class
when the class runs out, is offered to the items of smaller classes first, the least that suffices.

Defined cases: null and empty texts have no tokens and are put nowhere; a capacity below one is refused; repeated rows
are packed each; ties are broken by id and part; an empty table gives no packs.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokens import VOCABULARY, with_token_count

#: Items of one bucket; a bucket is packed by one task.
BUCKET_ITEMS = 50_000
#: Sizes of at most C / CLASSES share the last class, whose packs are filled by size.
CLASSES = 64


def pack_bucket(sizes: list[int], capacity: int, classes: int = CLASSES) -> list[int]:
    """The pack of each item (sizes in falling order)."""
    rooms: list[tuple[int, int]] = []  # what is left in packs of classes that are done, with the pack
    out: list[int] = []
    packs, own, room, more, pack = 0, 0, 0, 0, 0  # own: the class at hand; its open pack, with its room and items to come
    for size in sizes:
        j = min(capacity // size, classes)
        if j != own:
            if more and room:
                insort(rooms, (room, pack))
            own, more = j, 0
        if more and j == classes and size > room:
            insort(rooms, (room, pack))
            more = 0
        i = bisect_left(rooms, (size, -1))
        if i < len(rooms):
            left, at = rooms.pop(i)
            out.append(at)
            if left > size:
                insort(rooms, (left - size, at))
            continue
        if not more:
            pack, room, more = packs, capacity, j if j < classes else 1 << 60
            packs += 1
        out.append(pack)
        room -= size
        more -= 1
        if not more and room:
            insort(rooms, (room, pack))
    return out


def pack_documents(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """``pack_name, capacity_tokens, bucket, pack, doc_id, part, from_token, n_tokens``: where each piece of each text is.

    ``specs`` is a small table of capacities by contract (a few rows); more than 1,000 are refused.
    """
    packs = [(r["pack_name"], r["capacity_tokens"]) for r in specs.select("pack_name", "capacity_tokens").distinct().limit(1001).collect()]
    if len(packs) > 1000 or any(c is None or c < 1 for _, c in packs):
        raise ValueError("a capacity is needed for each of at most 1,000 packs")
    sized = checkpoint(with_token_count(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "size", vocabulary).select("doc_id", "size").filter("size > 0"))
    if not packs:
        packs = [("", 1)]
        sized = sized.limit(0)
    pieces = sized.agg(*[F.sum(F.expr(f"(size + {c - 1}L) div {c}L")).alias(f"p{i}") for i, (_, c) in enumerate(sorted(packs))]).first()
    buckets = [max(1, -(-(pieces[i] or 0) // bucket_items)) for i in range(len(packs))]
    array = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity_tokens"), F.lit(b).cast("long").alias("_buckets")) for (n, c), b in zip(sorted(packs), buckets)])
    each = sized.withColumn("_p", F.explode(array)).select("doc_id", "size", "_p.*")
    parts = F.expr("sequence(0L, (size - 1) div capacity_tokens)")
    items = each.withColumn("part", F.explode(parts)).withColumn("from_token", F.col("part") * F.col("capacity_tokens"))
    items = items.withColumn("n_tokens", F.least(F.col("capacity_tokens"), F.col("size") - F.col("from_token"))).drop("size")
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.col("_buckets")).cast("int")).drop("_buckets")
    kind = items.schema["doc_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        pdf["pack"] = pack_bucket(pdf["n_tokens"].tolist(), int(pdf["capacity_tokens"].iloc[0]))
        return pdf[["pack_name", "capacity_tokens", "bucket", "pack", "doc_id", "part", "from_token", "n_tokens"]]

    return items.groupBy("pack_name", "bucket").applyInPandas(one, f"pack_name string, capacity_tokens long, bucket int, pack long, doc_id {kind}, part long, from_token long, n_tokens long")


def pack_report(packed: DataFrame) -> DataFrame:
    """``pack_name, capacity_tokens, packs, items, tokens, fill``: how full the packs are."""
    packs = packed.groupBy("pack_name", "capacity_tokens", "bucket", "pack").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    out = packs.groupBy("pack_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("packs"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return out.withColumn("fill", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6))
