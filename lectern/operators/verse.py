"""Lines whose breaks are the author's (verse, drama), and reflow of the rest.

All rules are windows over one document's lines: a break looks authorial if the line ends on
a mark that closes a phrase and the next one opens with a capital or a non-letter; a line is
protected if that holds often enough around it within its block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from .lines import in_order, spread, with_blocks, wrapped

CLOSERS = r"(?:[.,;:!?\"'’”—]|--)$"
WINDOW, RATE, LEAST = 6, 0.45, 3
CORROBORATE = RATE / 2
SPACED_BLANK, SPACED_ALONE = 0.40, 0.80


def profile(lines: DataFrame) -> DataFrame:
    """Adds ``authorial``: whether the break after a line looks meant (never before a blank line)."""
    base = with_blocks(lines)
    after = F.lead("s").over(in_order())
    opens = after.rlike(r"^(?:[\p{IsUppercase}]|[^\p{L}])")
    return base.withColumn("authorial", F.coalesce(~F.col("blank") & F.col("s").rlike(CLOSERS) & (after != "") & opens, F.lit(False)))


def rates(lines: DataFrame) -> DataFrame:
    """Adds ``rate``: the share of authorial breaks among the lines of the block within six lines."""
    near = Window.partitionBy("doc_id", "block_id").orderBy("line_no").rowsBetween(-WINDOW, WINDOW)
    got = profile(lines).where(~F.col("blank"))
    return got.withColumn("rate", F.avg(F.col("authorial").cast("int")).over(near))


def double_spaced(lines: DataFrame) -> DataFrame:
    """(doc_id): documents in which blank lines are line spacing, not structure."""
    base = with_blocks(lines)
    alone = (F.coalesce(F.lag("blank").over(in_order()), F.lit(True))) & (F.coalesce(F.lead("blank").over(in_order()), F.lit(True)))
    per = base.withColumn("_alone", alone & ~F.col("blank")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("blank").cast("int")).alias("b"), F.sum(F.col("_alone").cast("int")).alias("a"))
    text = F.col("n") - F.col("b")
    return per.where((text >= 10) & (F.col("b") >= SPACED_BLANK * F.col("n")) & (F.col("a") >= SPACED_ALONE * text)).select("doc_id")


def modal_layout(lines: DataFrame) -> DataFrame:
    """(doc_id, modal_indent, modal_blank_run): the commonest indentation of lines with text and length of runs of
    blank lines; of equally common ones that which comes first.  Null where there is none.
    """
    base = with_blocks(lines)
    text = base.where("not blank").withColumn("v", F.length(F.regexp_extract("line", r"^[ \t]*", 0))).select("doc_id", F.lit("i").alias("k"), "v", "line_no")
    start = base.withColumn("_new", F.coalesce(F.lag("blank").over(in_order()), F.lit(False)) != F.col("blank")).withColumn("_g", F.sum(F.col("_new").cast("int")).over(in_order()))
    runs = start.where("blank").groupBy("doc_id", "_g").agg(F.count(F.lit(1)).cast("int").alias("v"), F.min("line_no").alias("line_no"))
    both = text.unionByName(runs.select("doc_id", F.lit("b").alias("k"), "v", "line_no"))
    per = both.groupBy("doc_id", "k", "v").agg(F.count(F.lit(1)).alias("c"), F.min("line_no").alias("f"))
    mode = lambda k: F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.struct("c", -F.col("f"))))
    return per.groupBy("doc_id").agg(mode("i").alias("modal_indent"), mode("b").alias("modal_blank_run"))


def despaced(lines: DataFrame, spaced: DataFrame) -> DataFrame:
    """Lines without the blank lines that are spacing (``spaced``: such documents); of a longer run than usual one stays."""
    own = with_blocks(lines.join(spaced.select("doc_id"), "doc_id", "left_semi"))
    new = F.col("blank") & ~F.coalesce(F.lag("blank").over(in_order()), F.lit(False))
    own = own.withColumn("_g", F.when(F.col("blank"), F.sum(new.cast("int")).over(in_order())))
    run = Window.partitionBy("doc_id", "_g")
    own = own.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_f", F.min("line_no").over(run)).join(modal_layout(lines.join(spaced.select("doc_id"), "doc_id", "left_semi")).select("doc_id", "modal_blank_run"), "doc_id")
    kept = own.where(~F.col("blank") | ((F.col("_n") > F.col("modal_blank_run")) & (F.col("line_no") == F.col("_f")))).select("doc_id", "line_no", "line")
    return lines.select("doc_id", "line_no", "line").join(spaced.select("doc_id"), "doc_id", "left_anti").unionByName(kept)


def protected_spans(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, n_lines) of protected passages; only hard-wrapped documents have any."""
    hard = wrapped(lines).where("is_wrapped").select("doc_id")
    base = cut(lines.join(hard, "doc_id", "left_semi"))
    # where blank lines are spacing, the rule runs without them, then maps back
    full = despaced(base, cut(double_spaced(base))).withColumn("_true", F.col("line_no"))
    dense = full.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("_true"))).select("doc_id", "line_no", "line", "_true")
    rated = rates(dense).withColumn("_p", F.col("rate") >= RATE)
    block = rated.groupBy("doc_id", "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_p").cast("int")).alias("p"), F.avg(F.col("authorial").cast("int")).alias("share"), F.min("line_no").alias("b_first"), F.max("line_no").alias("b_last"), F.min("_true").alias("t_first"), F.max("_true").alias("t_last")
    )
    by = Window.partitionBy("doc_id").orderBy("block_id")
    strong = (F.col("p") >= LEAST) & (F.col("p") >= 0.5 * F.col("n"))
    block = block.withColumn("_strong", strong)
    beside = F.coalesce(F.lag("_strong").over(by), F.lit(False)) | F.coalesce(F.lead("_strong").over(by), F.lit(False))
    kept = block.withColumn("_keep", (F.col("p") > 0) | ((F.col("n") >= LEAST) & (F.col("share") >= CORROBORATE) & beside)).withColumn("_rank", F.row_number().over(by))
    # neighbouring kept blocks are one passage, blank lines between them included
    island = F.col("_rank") - F.row_number().over(Window.partitionBy("doc_id").orderBy("block_id"))
    spans = kept.where("_keep").withColumn("_g", island).groupBy("doc_id", "_g").agg(F.min("t_first").alias("first_line"), F.max("t_last").alias("last_line"))
    return spans.select("doc_id", "first_line", "last_line", (F.col("last_line") - F.col("first_line") + 1).alias("n_lines")).where(F.col("n_lines") >= LEAST)


def reflow(lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_id, first_line, text): blocks with their lines joined, unless protected, a short
    heading, a single line, or of a document that isn't hard-wrapped; those keep their lines.
    """
    spans = protected_spans(lines) if spans is None else spans
    inside = spread(spans).withColumn("_kept", F.lit(1))
    full = with_blocks(lines).where(~F.col("blank")).join(inside, ["doc_id", "line_no"], "left").join(wrapped(lines).select("doc_id", "is_wrapped"), "doc_id")
    grouped = full.groupBy("doc_id", "block_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"), F.max("_kept").alias("_kept"), F.first("is_wrapped").alias("_wrapped"))
    rows = F.transform("_l", lambda x: x["line"])
    indent = F.regexp_extract(rows[0], r"^[ \t]*", 0)
    keep = F.col("_kept").isNotNull() | ~F.col("_wrapped") | (F.size("_l") == 1)  # a heading is a single line
    text = F.when(keep, F.array_join(rows, "\n")).otherwise(F.concat(indent, T.join_wrapped(rows)))
    return grouped.select("doc_id", "block_id", F.col("_l")[0]["line_no"].alias("first_line"), F.size("_l").alias("n_lines"), (~keep).alias("joined"), text.alias("text"))
