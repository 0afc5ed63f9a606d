"""The pN_ queries: each applies its problem's operator to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import p1_garbled, p2_markup, p3_quality, p4_lookalike, p5_scans, p6_tokens, p7_mix, p8_sentences

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of doc_lines and whole texts of documents, as one table of (origin, rec_id, line_no, text)."""
    lines = table(spark, d, "doc_lines").select(F.lit("doc_lines").alias("origin"), F.col("file_id").alias("rec_id"), "line_no", F.col("line").alias("text"))
    docs = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("rec_id"), F.lit(None).cast("int").alias("line_no"), "text")
    return lines.unionByName(docs)


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    found = p1_garbled.find(_texts(spark, d), "text", ["origin", "rec_id", "line_no"])
    return found.select("origin", "rec_id", F.coalesce("line_no", "_line").alias("line_no"), "garbled", "restored", "whole").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = p1_garbled.find(_texts(spark, d), "text", ["origin", "rec_id", "line_no"])
    return found.select("origin", "rec_id", F.coalesce("line_no", "_line").alias("line_no")).distinct()


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_lines").select("file_id", "line_no", "line")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_markup.languages(_lines(spark, d)).where(F.col("certainty") > p2_markup.SURE).select("file_id", "syntax")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return p2_markup.clean(_lines(spark, d))


def _common(spark: SparkSession, d: str) -> dict[str, list[str]]:
    return p3_quality.common_words(table(spark, d, "common_words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    got = p3_quality.shapes(_lines(spark, d), _common(spark, d))
    return got.where(F.col("shape").isin(*p3_quality.SHAPES)).select("file_id", "shape")


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    return p3_quality.shapes(_lines(spark, d), _common(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_quality.file_sums(_lines(spark, d), _common(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_lookalike.pairs(_lines(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return p4_lookalike.classes(_lines(spark, d))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return p4_lookalike.canonical(_lines(spark, d), "line", ["file_id", "line_no"]).select("file_id", "line_no", "canonical").distinct()


def p5_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return p5_scans.corpus_lexicon(table(spark, d, "extractions"), table(spark, d, "doc_lines"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_scans.found(table(spark, d, "extractions"), table(spark, d, "doc_lines"))[0]


def p5_repairs(spark: SparkSession, d: str) -> DataFrame:
    return p5_scans.found(table(spark, d, "extractions"), table(spark, d, "doc_lines"))[1].drop("place").distinct()


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return p5_scans.paragraphs(table(spark, d, "extractions"), table(spark, d, "doc_lines"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return p6_tokens.encode(table(spark, d, "documents").select("doc_id", "text"), keep=["doc_id"])


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return p6_tokens.token_counts(docs, keep=["doc_id", "source"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    return p7_mix.unreachable(cut(_sizes(spark, d)), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    return p7_mix.shares(cut(_sizes(spark, d)), table(spark, d, "mix_targets"))


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    from ..session import cut

    return p7_mix.sample(cut(_sizes(spark, d)), table(spark, d, "mix_targets"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "split_tasks").select("doc_id").distinct()
    return table(spark, d, "documents").select("doc_id", "text").join(asked, "doc_id", "left_semi")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_sentences.units(_asked(spark, d)).select("doc_id", "start_pos").distinct()


def p8_units(spark: SparkSession, d: str) -> DataFrame:
    return p8_sentences.units(table(spark, d, "documents").select("doc_id", "text"), content=True)


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_restored": p1_restored,
        "p2_found": p2_found,
        "p2_clean": p2_clean,
        "p3_found": p3_found,
        "p3_stats": p3_stats,
        "p3_counts": p3_counts,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p4_forms": p4_forms,
        "p5_found": p5_found,
        "p5_lexicon": p5_lexicon,
        "p5_repairs": p5_repairs,
        "p5_paragraphs": p5_paragraphs,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_shares": p7_shares,
        "p7_mixed": p7_mixed,
        "p8_found": p8_found,
        "p8_units": p8_units,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as known

    return known()
