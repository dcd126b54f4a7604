"""Problem 9: one form for text that looks the same in different characters.

The form is computed by SQL in DuckDB inside Arrow partitions. It maps line ends, invisible characters, spaces of
another kind, full-width forms, Latin ligatures and letters of other scripts that have the very shape of a Latin letter, and
composes accents (NFC) last, so that they join mapped letters too. Differences that can be seen stay: case, accents, superscripts, similar shapes such
as ``l`` and ``1`` or Greek nu and ``v``. It is a key for comparison: Cyrillic text keeps its own letters but for the
look-alikes, so it is not meant for display.

Defined cases: null text has a null form and no partner; empty text has the empty form; repeated rows are compared like
others (the same characters are no pair); long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import checkpoint, widen

# Letters of exactly the same shape.
LOOK_ALIKES = {
    "АВЕКМНОРСТХІЈЅҮӀԌԚԜЁЇӐӒӖЀӦ": "ABEKMHOPCTXIJSYIGQWËÏĂÄĔÈÖ",
    "аеорсухіјѕһӏԁԛԝёїӑӓӗѐӧ": "aeopcyxijshldqwëïăäĕèö",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿΪΫοϲϳό": "ABEZHIKMNOPTYXCJÏŸocjó",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Spaces that only differ from the space in width or in breaking the line.
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)
#: Characters without a picture; joiners and selectors stay within pictographs, where they can be seen.
INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{E0001}]"
JOINERS = r"(^|[^\p{So}\x{200D}\x{FE0F}\x{1F3FB}-\x{1F3FF}#*0-9])[\x{200D}\x{FE00}-\x{FE0F}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(text: str = "text") -> str:
    """The SQL expression of the form of column ``text``."""
    e = f"regexp_replace(replace({text}, chr(13) || chr(10), chr(10)), '{JOINERS}', '\\1', 'g')"
    e = f"regexp_replace(replace({e}, chr(13), chr(10)), '{INVISIBLE}', '', 'g')"
    looks = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())
    e = f"translate({e}, {_quoted(SPACES + FULL_WIDTH + looks[0])}, {_quoted(' ' * len(SPACES) + HALF + looks[1])})"
    for a, b in LIGATURES.items():
        e = f"replace({e}, '{a}', '{b}')"
    return f"nfc_normalize({e})"


#: Work of one SQL call, so that long texts do not pile up.
_CHARS = 4_000_000


def _run(columns: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        sql = f"SELECT {columns} FROM (SELECT *, CASE WHEN strlen(text) = length(text) AND NOT contains(text, chr(13)) THEN text ELSE {form_sql()} END AS form FROM part)"
        for batch in batches:
            size = max(1, batch.num_rows * _CHARS // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, size):
                part = pa.Table.from_batches([batch.slice(at, size)])
                con.register("part", part)
                yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
                con.unregister("part")

    return run


def visual_form(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, form, changed``: every text in its one form."""
    kind = docs.schema[id_col].dataType.simpleString()
    part = widen(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")))
    out = part.mapInArrow(_run("id, form, form IS DISTINCT FROM text AS changed", pa.schema([("id", pa.string()), ("form", pa.string()), ("changed", pa.bool_())])), "id string, form string, changed boolean")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def form_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, form_key, text_key``: 128-bit keys of form and text, so that no text is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    part = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    part = widen(part)
    out = part.mapInArrow(_run("id, md5(form) AS form_key, md5(text) AS text_key", pa.schema([("id", pa.string()), ("form_key", pa.string()), ("text_key", pa.string())])), "id string, form_key string, text_key string")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row whose form other texts have too: its class (``form_key``), its text's key, and the numbers of different
    texts and of rows of the class."""
    keys = checkpoint(form_keys(docs, id_col, text_col))
    texts = keys.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("_n")).groupBy("form_key").agg(F.count(F.lit(1)).alias("variants"), F.sum("_n").alias("copies")).filter("variants > 1")
    return keys.join(texts, "form_key")


def look_alike_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_a, doc_b``: the links between different texts of one form, each text stood for by its smallest id; every text
    of a class is linked with the class's first."""
    keys = form_keys(docs, id_col, text_col)
    first = checkpoint(keys.groupBy("form_key", "text_key").agg(F.min(id_col).alias("id")))
    least = first.groupBy("form_key").agg(F.min("id").alias("doc_a"))
    return first.join(least, "form_key").filter("id <> doc_a").select("doc_a", F.col("id").alias("doc_b"))


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs ``doc_a < doc_b`` of different texts of one form. Different texts of a class are paired first; then each side
    takes in its copies, so exact copies are not joined to each other. Keys with many copies are split over tasks."""
    keys = checkpoint(form_keys(docs, id_col, text_col).select(F.col(id_col).alias("id"), "form_key", "text_key"))
    texts = keys.select("form_key", "text_key").distinct()
    mixed = texts.groupBy("form_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("form_key")
    few = checkpoint(keys.join(mixed, "form_key", "left_semi"))
    texts = few.select("form_key", "text_key").distinct()
    a, b = texts.select("form_key", F.col("text_key").alias("text_a")), texts.select("form_key", F.col("text_key").alias("text_b"))
    pairs = a.join(b, "form_key").filter("text_a < text_b")
    left = skew_join(few.select("form_key", F.col("text_key").alias("text_a"), F.col("id").alias("a")), pairs, ["form_key", "text_a"])
    both = left.join(few.select("form_key", F.col("text_key").alias("text_b"), F.col("id").alias("b")), ["form_key", "text_b"])
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
