"""Queries of the operators on texts; added to the entry point only if this subpackage can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, table
from . import mixing, origin, packing, pairs, syntax, visual


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("path").isNotNull())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return origin.not_hand_written(table(spark, d, "file_record"), table(spark, d, "documents")).select("repo", "path")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files named by each reason."""
    found = origin.not_hand_written(table(spark, d, "file_record"), table(spark, d, "documents"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(_sources(spark, d))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and documentation, also from separate declarations and the symbol graph."""
    return pairs.documented(_sources(spark, d), table(spark, d, "code_node")).select("repo", "path", "language", "qualified_name", "signature", "documentation", "code", "source")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    files = _sources(spark, d).select("repo", "path", "text")
    return syntax.flag_unparsable(files).filter("NOT valid").select("repo", "path").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files and their rate per repository and language, each path once."""
    files = _sources(spark, d).select("repo", "path", "text")
    flagged = syntax.flag_unparsable(files).groupBy("repo", "path", "language").agg(F.min("valid").alias("valid"))
    return syntax.invalid_rates(flagged)


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_spec"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p7_packs(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(checkpoint(p8_mix(spark, d)), table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.look_alike_pairs(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    """The key of each document's form, and whether the form differs from the text."""
    f = visual.visual_form(table(spark, d, "documents"))
    return f.select("doc_id", F.md5("form").alias("form_key"), "changed")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents of classes of several texts that look the same, with the sizes of their class."""
    return visual.look_alike_classes(table(spark, d, "documents")).select("doc_id", "form_key", "variants", "copies")


def p9_links(spark: SparkSession, d: str) -> DataFrame:
    """One link for each text to the first of its class; membership is in ``p9_classes``."""
    return visual.look_alike_texts(table(spark, d, "documents"))


def queries() -> dict:
    own = (p1_found, p1_reasons, p3_found, p3_pairs, p5_found, p5_rates, p7_packs, p7_fill, p8_mix, p8_shares, p9_found, p9_forms, p9_classes, p9_links)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    form = visual.form_sql()
    return {
        "p9_found": f"""WITH f AS MATERIALIZED (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
        "p9_classes": f"""WITH f AS MATERIALIZED (SELECT doc_id, text, md5({form}) AS form_key FROM documents WHERE text IS NOT NULL)
SELECT doc_id, form_key, c.variants, c.copies FROM f JOIN (SELECT form_key, count(DISTINCT text) AS variants, count(*) AS copies FROM f GROUP BY 1 HAVING count(DISTINCT text) > 1) c USING (form_key)""",
        "p9_links": f"""WITH f AS MATERIALIZED (SELECT text, md5({form}) AS form_key, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT c.id AS doc_a, f.id AS doc_b FROM f JOIN (SELECT form_key, min(id) AS id FROM f GROUP BY 1) c USING (form_key) WHERE f.id <> c.id""",
        "p9_forms": f"SELECT doc_id, md5({form}) AS form_key, ({form}) IS DISTINCT FROM text AS changed FROM documents",
    }
