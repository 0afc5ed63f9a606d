"""Lines that were delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, if_small

SMALL = 200_000  # a table of files up to so many rows (counted) is broadcast


def once(doc_lines: DataFrame) -> DataFrame:
    """(file_id, line_no, line), one row per key: only files whose line numbers aren't plainly a run without
    repeats (by count, sum and a hash over all numbers) are brought together.
    """
    lines = doc_lines.select("file_id", "line_no", "line")
    no = F.col("line_no")
    per = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("line_no").alias("m"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.sum(no.cast("long")).alias("s"), F.bit_xor(F.xxhash64("line_no")).alias("x"))
    run = F.aggregate(F.sequence("lo", "hi"), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(F.xxhash64(i)))
    whole = (F.col("n") == F.col("m")) & (F.col("n") == F.col("hi") - F.col("lo") + 1) & (F.col("s") * 2 == (F.col("lo") + F.col("hi")) * F.col("n"))
    odd = if_small(cut(per.where(~F.coalesce(whole, F.lit(False)) | (F.when(whole, run) != F.col("x"))).where("file_id is not null").select("file_id")), SMALL)
    more = lines.join(odd, "file_id", "left_semi").groupBy("file_id", "line_no").agg(F.max("line").alias("line"))
    return lines.join(odd, "file_id", "left_anti").unionByName(more)
