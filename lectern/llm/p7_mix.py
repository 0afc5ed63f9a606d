"""Mixing of sources to target shares of a total size.

Method: systematic sampling.  Within a source every document is expected the same
number of copies; the running sum of expected copies plus one random offset is formed,
and a copy is emitted for each integer boundary that a document's stretch crosses.  The
running sum is a distributed prefix sum: documents fall into ``BUCKETS`` hash buckets
per source, are numbered within a bucket, and each bucket starts where the buckets
before it end, so that a source with a third of all documents is no single task.

Defined results: null and empty texts have size 0 but are still sampled; a source with
a target but no documents comes out with 0; documents of sources without a target (null
included) count towards the total size and are never drawn; a target that is null or
not above 0 draws nothing; repeated target rows of one source: the largest share and cap count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
SEED = 20260101


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: what is there, and the expected copies of each document.

    ``sizes``: doc_id, source, n_tokens.  ``targets``: source, target_share, max_repeats.
    The whole is as large as all of ``sizes``.
    """
    there = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("docs"))
    total = there.agg(F.coalesce(F.sum("available_tokens"), F.lit(0)).alias("total_tokens"))
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    joined = wanted.join(there, "source", "left").na.fill(0, ["available_tokens", "docs"]).withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")  # the total is one row
    want = F.col("target_share") * F.col("total_tokens")
    copies = F.when(F.col("available_tokens") > 0, F.least(want / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return joined.withColumns(
        {
            "target_tokens": want,
            "copies_per_doc": copies,
            "reachable": F.col("available_tokens") * F.col("max_repeats") >= want,
        }
    )


def sample(sizes: DataFrame, targets: DataFrame, seed: int = SEED, full: bool = False) -> DataFrame:
    """The mix: doc_id, source, n_tokens, copy_no (from 1).  ``full``: every document at its cap, whatever the target."""
    quota = plan(sizes, targets)
    quota = quota.select("source", F.col("max_repeats").cast("double").alias("copies_per_doc") if full else F.col("copies_per_doc"))
    # the targets are a table given by hand, one row per source: the join side is as small as that
    drawn = sizes.join(quota, "source").withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS)))
    heads = drawn.groupBy("source", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ordered = Window.partitionBy("source", "_b").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    place = drawn.withColumn("_k", F.row_number().over(ordered)).join(heads, ["source", "_b"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    up_to = lambda k: F.floor(k * F.col("copies_per_doc") + offset)
    rank = F.col("_before") + F.col("_k")
    crossed = (up_to(rank) - up_to(rank - 1)).cast("int")
    got = place.withColumn("_c", crossed).where("_c > 0")
    return got.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("copy_no"))


def shares(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """The report: per target, what was asked for and what the mix holds."""
    mix = sample(sizes, targets, seed).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"))
    report = plan(sizes, targets).join(mix, "source", "left").na.fill(0, ["mixed_tokens", "mixed_docs"])
    whole = mix.agg(F.sum("mixed_tokens").alias("_all"))
    share_of = lambda c: F.when(F.col(c) > 0, F.col("mixed_tokens") / F.col(c)).otherwise(F.lit(0.0))
    return report.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one").select(
        "source", "target_share", "max_repeats", "docs", "available_tokens", "total_tokens", "copies_per_doc", "reachable", "mixed_docs", "mixed_tokens",
        share_of("total_tokens").alias("share_of_total"), share_of("_all").alias("share_of_mix"),
    )


def unreachable(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """The sources whose share stays below the target in the mix that holds every document at its cap."""
    mix = sample(sizes, targets, seed, full=True).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    held = plan(sizes, targets).join(mix, "source", "left").na.fill(0, ["mixed_tokens"])
    return held.where("mixed_tokens < target_tokens").select("source").distinct()
