"""Interface labels in copied threads: controls such as Reply or "3 likes" at the end of records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from .lines import in_order

RECORDS, WITH, SHARE = 5, 3, 0.20


def records(lines: DataFrame) -> DataFrame:
    """Lines with text, with ``record``: a running count of handles, or of times where handles are too few.

    Documents with fewer than five of either are left out.
    """
    s = T.strip(F.coalesce("line", F.lit("")))
    base = lines.withColumn("s", s).where("s <> ''").withColumn("_h", T.is_handle(F.col("s"))).withColumn("_t", T.is_relative_time(F.col("s")))
    per = Window.partitionBy("doc_id")
    handles, times = F.sum(F.col("_h").cast("int")).over(per), F.sum(F.col("_t").cast("int")).over(per)
    start = F.when(handles >= RECORDS, F.col("_h")).when(times >= RECORDS, F.col("_t"))
    got = base.withColumn("_start", start).where("_start is not null")
    return got.withColumn("record", F.sum(F.col("_start").cast("int")).over(in_order()).cast("int")).where("record > 0").withColumn("is_body", ~F.col("_h") & ~F.col("_t")).select("doc_id", "line_no", "s", "record", "is_body")


def tails(lines: DataFrame) -> DataFrame:
    """(doc_id, record, line_no, key): the trailing run of label-shaped lines of each record, one body line left."""
    body = records(lines).where("is_body").withColumn("_l", T.label_shaped(F.col("s")))
    order = Window.partitionBy("doc_id", "record").orderBy(F.desc("line_no"))
    run = F.min(F.col("_l").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "record"))
    got = body.withColumn("_run", run).withColumn("_r", F.row_number().over(order)).withColumn("_n", n)
    return got.where("_run = 1 and _r < _n").select("doc_id", "record", "line_no", T.control_key(F.col("s")).alias("key")).where("key <> ''")


def label_counts(lines: DataFrame) -> DataFrame:
    """(doc_id, key, records_with, records, confirmed): labels by the records they close."""
    total = records(lines).groupBy("doc_id").agg(F.countDistinct("record").cast("int").alias("records"))
    per = tails(lines).groupBy("doc_id", "key").agg(F.countDistinct("record").cast("int").alias("records_with"), F.min("line_no").alias("first_line"))
    got = per.join(total, "doc_id")
    return got.withColumn("confirmed", F.col("records_with") >= F.greatest(F.lit(WITH), F.bround(SHARE * F.col("records")).cast("int")))


def labels(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, key): lines that are interface labels.

    A label seen in three records joins the confirmed ones if every record that has it also has a
    confirmed one; keys are taken in order of appearance, and each may admit later ones.
    """
    tail = tails(lines)
    counts = label_counts(lines)
    per = tail.join(counts.select("doc_id", "key", "confirmed", "first_line", "records_with"), ["doc_id", "key"]).groupBy("doc_id", "key").agg(
        F.first("confirmed").alias("c"), F.first("first_line").alias("f"), F.first("records_with").alias("w"), F.collect_set("record").alias("r")
    )
    rows = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("f", "key", "c", "w", "r"))).alias("_k"))

    def admit(batch: pd.Series) -> pd.Series:
        out = []
        for keys in batch:
            taken = {k["key"] for k in keys if k["c"]}
            covered = {r for k in keys if k["c"] for r in k["r"]}
            for k in keys:
                if k["key"] not in taken and k["w"] >= WITH and taken and all(r in covered for r in k["r"]):
                    taken.add(k["key"])
                    covered |= set(k["r"])
            out.append(sorted(taken))
        return pd.Series(out)

    chosen = rows.withColumn("key", F.explode(F.pandas_udf(admit, Y.ArrayType(Y.StringType()))("_k"))).select("doc_id", "key")
    return tail.join(chosen, ["doc_id", "key"]).select("doc_id", "line_no", "key")
