"""The line relation: one row per line, its blocks and its basic properties.

Relations are keyed by ``doc_id`` and ``line_no`` (from 1).  Null lines count as blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import text as T

def in_order() -> WindowSpec:
    """A document's lines in order.  (A function: workers import this module without a session.)"""
    return Window.partitionBy("doc_id").orderBy("line_no")


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of whole texts, CRLF and CR read as LF; an empty text is one blank line, a null one none."""
    unix = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.posexplode(F.split(unix, "\n")).alias("_p", "line"))
    return rows.select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")


def with_blocks(lines: DataFrame) -> DataFrame:
    """Adds ``s`` (stripped), ``blank`` and ``block_id`` (number of blank lines before): gaps and islands."""
    base = lines.withColumn("s", T.strip(F.coalesce("line", F.lit("")))).withColumn("blank", F.col("s") == "")
    return base.withColumn("block_id", F.sum(F.col("blank").cast("int")).over(in_order()).cast("int"))


def spread(spans: DataFrame, *cols: str) -> DataFrame:
    """(doc_id, cols, line_no): a row for each line of spans from ``first_line`` to ``last_line``.

    The planner takes this for as small as the file of the spans and would send all lines of the corpus to the
    driver for a broadcast, so the next join is asked to sort and merge.
    """
    return spans.select("doc_id", *cols, F.explode(F.sequence("first_line", "last_line")).alias("line_no")).hint("merge")


def blocks(lines: DataFrame) -> DataFrame:
    """One row per run of non-blank lines."""
    full = with_blocks(lines).where(~F.col("blank"))
    return full.groupBy("doc_id", "block_id").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count(F.lit(1)).alias("n_lines"), F.max(F.length("s")).alias("longest")
    )


def newline_style(text: Column) -> Column:
    """CRLF, LF or CR by majority; CRLF wins ties, an empty count included."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf = F.regexp_count(text, F.lit("\n")) - crlf
    cr = F.regexp_count(text, F.lit("\r")) - crlf
    return F.when((crlf >= lf) & (crlf >= cr), F.lit("CRLF")).when(lf >= cr, F.lit("LF")).otherwise(F.lit("CR"))


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Characters, lines, word tokens and word types of each document; 0 for null and empty texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = T.words(t)
    out = docs.select(F.col(key).alias("doc_id"), t.alias("_t"), tokens.alias("_w"))
    return out.select(
        "doc_id", F.length("_t").alias("characters"), F.when(F.col("_t") == "", 0).otherwise(F.size(F.split("_t", "\n"))).alias("line_count"),
        F.size("_w").alias("word_tokens"), F.size(F.array_distinct(F.transform("_w", F.lower))).alias("word_types"),
    )


def wrapped(lines: DataFrame) -> DataFrame:
    """(doc_id, text_lines, p95, is_wrapped): hard-wrapped if the nearest-rank 95th percentile of
    the line lengths is at most 200; fewer than ten lines with text are never wrapped.
    """
    full = lines.where(T.strip(F.coalesce("line", F.lit(""))) != "").groupBy("doc_id", F.length("line").alias("_l")).agg(F.count(F.lit(1)).alias("_c"))
    # lengths are few: they are counted first, and the rank is found among the counts
    upto = F.sum("_c").over(Window.partitionBy("doc_id").orderBy("_l"))
    total = F.sum("_c").over(Window.partitionBy("doc_id"))
    rank = F.least(F.floor(total * 0.95) + 1, total)
    per = full.withColumns({"_u": upto, "_n": total, "_r": rank}).groupBy("doc_id").agg(F.max("_n").cast("int").alias("text_lines"), F.min(F.when(F.col("_u") >= F.col("_r"), F.col("_l"))).alias("p95"))
    return per.select("doc_id", "text_lines", "p95", ((F.col("text_lines") >= 10) & (F.col("p95") <= 200)).alias("is_wrapped"))


def usability(docs: DataFrame, key: str, text: str, pages: str | None = None, pages_with_text: str | None = None, producer: str | None = None) -> DataFrame:
    """(key, characters, letter_ratio, kind): image, unmapped, ocr or text, as an extraction can be used."""
    t = F.coalesce(F.col(text), F.lit(""))
    ratio = T.letter_ratio(t)
    few = F.lit(False) if pages is None else (F.col(pages) > 0) & (F.col(pages_with_text) < 0.5 * F.col(pages))
    ocr = F.lit(False) if producer is None else F.coalesce(F.lower(F.col(producer)).rlike("ocr|recogni|tesseract|abbyy|finereader"), F.lit(False))
    kind = F.when((F.length(T.strip(t)) == 0) | few, F.lit("image")).when((F.length(t) >= 200) & (ratio < 0.35), F.lit("unmapped")).when(ocr, F.lit("ocr")).otherwise(F.lit("text"))
    return docs.select(F.col(key), F.length(t).alias("characters"), F.round(ratio, 6).alias("letter_ratio"), kind.alias("kind"))
