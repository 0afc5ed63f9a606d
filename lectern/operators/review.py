"""The review loop: what detectors leave undecided, the answers, and their application.

Items are known by their content (kind, key), never by position, so that an answer survives
edits of the source and holds for every occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNDECIDED = "?"
HEADER = """\
# Review queue: one decision per line, tab-separated; edit the first column and read it again.
#   ?       undecided: nothing is changed
#   join    write the two parts as one word
#   keep    keep the hyphen
#   <text>  use exactly this
# DECISION\tTYPE\tITEM\tWHY
"""


def items(decided: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(kind, key, why, decision, lines): undecided breaks and unpaired notes over all documents, one row per content."""
    hyphens = decided.where("decision not in ('join', 'keep')").select(F.lit("hyphen").alias("kind"), F.col("hyphenated").alias("key"), F.col("reason").alias("why"), "doc_id", "line_no")
    if pairs is not None:
        lone = pairs.where("not paired").select(F.lit("footnote").alias("kind"), F.concat(F.lit("["), "label", F.lit("]")).alias("key"), F.lit("no partner found").alias("why"), "doc_id", F.coalesce("marker_line", "body_line").alias("line_no"))
        hyphens = hyphens.unionByName(lone)
    got = hyphens.groupBy("kind", "key").agg(F.min("why").alias("why"), F.count(F.lit(1)).cast("int").alias("occurrences"), F.slice(F.array_sort(F.collect_set(F.struct("doc_id", "line_no"))), 1, 4).alias("examples"))
    return got.withColumn("decision", F.lit(UNDECIDED))


def carry(queue: DataFrame, answered: DataFrame) -> DataFrame:
    """The queue with the decisions that were given before (kind, key, decision)."""
    old = answered.select("kind", "key", F.col("decision").alias("_old")).dropDuplicates(["kind", "key"])
    return queue.join(old, ["kind", "key"], "left").withColumn("decision", F.coalesce("_old", "decision")).drop("_old")


def outstanding(queue: DataFrame, answered: DataFrame) -> DataFrame:
    return queue.join(answered.where(F.col("decision") != UNDECIDED).select("kind", "key"), ["kind", "key"], "left_anti")


def write(queue: DataFrame, path: str) -> None:
    """As tab-separated lines, sorted by kind and key, with the explanation in front."""
    at = F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["line_no"].cast("string"))), ", ")
    clean = lambda c: F.regexp_replace(F.col(c), r"[\t\n]", " ")
    rows = queue.orderBy("kind", "key").select(F.concat_ws("\t", "decision", "kind", clean("key"), F.concat(clean("why"), F.lit(" ("), at, F.lit(")"))).alias("value"))
    rows.write.mode("overwrite").text(path)  # sorted ranges: the files' names are in order
    spark: SparkSession = queue.sparkSession
    spark.createDataFrame([(HEADER.rstrip("\n"),)], "value string").coalesce(1).write.mode("append").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, decision) of decided rows; comments, blank and short lines and undecided rows are skipped."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    got = rows.select(F.trim(F.col("f")[1]).alias("kind"), F.trim(F.col("f")[2]).alias("key"), F.trim(F.col("f")[0]).alias("decision"))
    return got.where(~F.col("decision").isin("", UNDECIDED)).dropDuplicates(["kind", "key"])


def apply(decided: DataFrame, answers: DataFrame) -> DataFrame:
    """Breaks with the answers applied; only undecided ones take any.  Adds ``resolved``: the word to write."""
    ours = answers.where("kind = 'hyphen'").select(F.col("key").alias("hyphenated"), F.col("decision").alias("_a")).dropDuplicates(["hyphenated"])
    got = decided.join(ours, "hyphenated", "left")
    open_ = ~F.col("decision").isin("join", "keep") & F.col("_a").isNotNull()
    literal = open_ & ~F.col("_a").isin("join", "keep")
    decision = F.when(literal, F.lit("join")).when(open_, F.col("_a")).otherwise(F.col("decision"))
    word = F.when(literal, F.col("_a")).when(decision == "join", F.col("joined")).when(decision == "keep", F.col("hyphenated"))
    reason = F.when(open_, F.lit("decided in review")).otherwise(F.col("reason"))
    return got.withColumns({"resolved": word, "reason": reason, "decision": decision}).drop("_a")
