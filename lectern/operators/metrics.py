"""Scores against answer keys, and the traffic light over what a cleaning removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARN, FAIL, SMALL = 8.0, 25.0, 2000  # percent of tokens lost; documents below so many tokens aren't judged by it


def per_label(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) over lines: both (doc_id, line_no, label); only keyed lines count."""
    both = truth.select("doc_id", "line_no", F.col("label").alias("t")).join(found.select("doc_id", "line_no", F.col("label").alias("p")), ["doc_id", "line_no"], "left")
    rows = both.select(F.explode(F.array_distinct(F.array("t", F.coalesce("p", F.lit("(none)"))))).alias("label"), "t", "p")
    hit = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    got = rows.where("label <> '(none)'").groupBy("label").agg(
        hit((F.col("t") == F.col("label")) & F.col("p").eqNullSafe(F.col("label"))).alias("tp"), hit((F.col("t") != F.col("label")) & F.col("p").eqNullSafe(F.col("label"))).alias("fp"), hit((F.col("t") == F.col("label")) & ~F.col("p").eqNullSafe(F.col("label"))).alias("fn")
    )
    return _scores(got)


def sets(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) for sets of keys."""
    t, p = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), found.select(*keys).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, keys, "full")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    got = both.agg(count(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"), count(F.col("_t").isNull()).alias("fp"), count(F.col("_p").isNull()).alias("fn"))
    return _scores(got)


def _scores(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def invented(lines: DataFrame, rendered: DataFrame) -> DataFrame:
    """(doc_id, variant, line): output lines that the source doesn't have; none without repairs."""
    out = rendered.select("doc_id", "variant", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    source = lines.select("doc_id", F.regexp_replace(F.coalesce("line", F.lit("")), "[ \t]+$", "").alias("line")).distinct().hint("merge")
    return out.join(source, ["doc_id", "line"], "left_anti").select("doc_id", "variant", "line")


def fidelity(lines: DataFrame, rendered: DataFrame) -> DataFrame:
    """(doc_id, variant, output_lines, invented_lines): lines with text, and those of them that the source doesn't have."""
    out = rendered.select("doc_id", "variant", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    source = lines.select("doc_id", F.regexp_replace(F.coalesce("line", F.lit("")), "[ \t]+$", "").alias("line")).distinct().withColumn("_own", F.lit(1)).hint("merge")
    both = out.join(source, ["doc_id", "line"], "left")
    return both.groupBy("doc_id", "variant").agg(F.count(F.lit(1)).alias("output_lines"), F.sum(F.col("_own").isNull().cast("int")).alias("invented_lines"))


def verdicts(measured: DataFrame, uncovered: DataFrame | None = None) -> DataFrame:
    """(doc_id, variant, token_percent, verdict): RED if a quarter of the words or more is lost, lines are
    uncovered or there are no words at all, AMBER from 8 percent, GREEN else; small documents are judged by cover alone.
    """
    got = measured
    if uncovered is not None:
        got = got.join(uncovered.select("doc_id").distinct().withColumn("_u", F.lit(True)), "doc_id", "left")
    else:
        got = got.withColumn("_u", F.lit(None).cast("boolean"))
    loss = -F.coalesce("token_percent", F.lit(0.0))
    judged = F.col("base_tokens") >= SMALL
    verdict = F.when(F.col("_u") | (F.col("base_tokens") == 0) | (judged & (loss >= FAIL)), F.lit("RED")).when(judged & (loss >= WARN), F.lit("AMBER")).otherwise(F.lit("GREEN"))
    return got.select("doc_id", "variant", "token_percent", verdict.alias("verdict"))


def triage(usable: DataFrame) -> DataFrame:
    """(kind, documents, characters, advice) of a folder of extractions."""
    advice = F.when(F.col("kind") == "image", F.lit("no text layer: recognise the pages first")).when(F.col("kind") == "unmapped", F.lit("glyphs without letters: recognise the pages")).when(F.col("kind") == "ocr", F.lit("recognised text: repair before use")).otherwise(F.lit("use as it is"))
    return usable.groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("characters").alias("characters")).withColumn("advice", advice)
