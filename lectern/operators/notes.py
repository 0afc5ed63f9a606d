"""Footnotes: bodies, markers, and their pairing.

A note opens a line with its label in brackets and goes on to a blank line, the next note or
``LONGEST`` lines on; all its lines are its text.  A marker is such a label inside a line.
A body belongs to the nearest marker of its label before it that no body between them took:
that is how brackets match, so a running depth per label finds it in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import in_order

# Labels are a number, one or two letters, or a numbered FN; the brackets; the word that names a note.
LABELS = ("[0-9]{1,4}", "[A-Za-z]{1,2}", "FN#[0-9]{1,4}")
BRACKETS = (("\\[", "\\]"), ("\\{", "\\}"))
NAME = "Footnote"
LONGEST = 40

_LABEL = "|".join(LABELS)
MARKER = "|".join(f"{a}(?:{_LABEL}){z}" for a, z in BRACKETS)
OPENING = "(?:" + "|".join(f"{a}(?:{_LABEL}){z}" for a, z in BRACKETS) + ")"
#: the label's brackets, then text
BODY = f"^\\s*({OPENING})\\s*[:.]?\\s+(\\S.*)$"
NAMED_BODY = f"(?i)^\\s*\\[{NAME}\\s+([A-Za-z0-9#]{{1,6}})\\s*[:.]?\\s*(.*)$"


def _inner(bracketed: Column) -> Column:
    return F.regexp_replace(bracketed, r"^[\[{]|[\]}]$", "")


def marked(lines: DataFrame) -> DataFrame:
    """Lines with ``label`` and ``own`` (text after the label) where a note opens, and ``first``: the line that its note opened on."""
    s = F.coalesce("line", F.lit(""))
    some = lambda pattern, k: F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))
    label = F.coalesce(_inner(some(BODY, 1)), some(NAMED_BODY, 1))
    base = lines.select("doc_id", "line_no", s.alias("line"), label.alias("label"), F.coalesce(some(BODY, 2), F.regexp_extract(s, NAMED_BODY, 2)).alias("own"))
    stop = F.col("label").isNotNull() | (T.strip(F.col("line")) == "")
    # the last stop up to here tells whose line this is; a gap in the numbers stops a note as well
    jump = F.col("line_no") != F.coalesce(F.lag("line_no").over(in_order()), F.lit(-1)) + 1
    near = F.last(F.when(stop | jump, F.struct("line_no", "label")), ignorenulls=True).over(in_order())
    got = base.withColumn("_n", near)
    held = F.col("_n.label").isNotNull() & (F.col("line_no") - F.col("_n.line_no") < LONGEST)
    return got.withColumn("first", F.when(held, F.col("_n.line_no"))).drop("_n")


def bodies(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, label, text): the notes, with the text of all their lines."""
    part = T.strip(F.when(F.col("label").isNotNull(), F.col("own")).otherwise(F.col("line")))
    got = marked(lines).where("first is not null").groupBy("doc_id", "first").agg(
        F.max("line_no").alias("last_line"), F.max("label").alias("label"), F.array_sort(F.collect_list(F.struct("line_no", part.alias("t")))).alias("_t")
    )
    text = T.strip(F.array_join(F.transform("_t", lambda x: x["t"]), " "))
    return got.select("doc_id", F.col("first").alias("first_line"), "last_line", T.note_label(F.col("label")).alias("label"), text.alias("text"))


def markers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, label): bracketed labels outside of notes, but for one alone on its line (a page or item number)."""
    alone = T.strip(F.col("line")).rlike(f"^{OPENING}$")
    rest = marked(lines).where(F.col("first").isNull() & ~alone)
    hits = rest.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(MARKER), F.lit(0))).alias("pos", "m"))
    return hits.select("doc_id", "line_no", "pos", T.note_label(_inner(F.col("m"))).alias("label"))


def pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, label, marker_line, body_line, paired); what finds no partner is reported unpaired."""
    events = markers(lines).select("doc_id", "label", F.col("line_no").alias("line"), "pos", F.lit(1).alias("step"))
    events = events.unionByName(bodies(lines).select("doc_id", "label", F.col("first_line").alias("line"), F.lit(0).alias("pos"), F.lit(-1).alias("step")))
    order = Window.partitionBy("doc_id", "label").orderBy("line", "pos")
    deep = events.withColumn("s", F.sum("step").over(order)).withColumn("low", F.least(F.min("s").over(order), F.lit(0)))
    # a body that finds the depth at its lowest has no marker left
    lone = (F.col("step") < 0) & (F.col("low") < F.coalesce(F.lag("low").over(order), F.lit(0)))
    deep = deep.withColumn("level", F.when(lone, F.lit(0)).otherwise(F.col("s") - F.col("low") + (F.col("step") < 0).cast("int")))
    # at one level markers and bodies take turns
    turn = Window.partitionBy("doc_id", "label", "level").orderBy("line", "pos")
    deep = deep.withColumn("_m", F.when((F.col("step") < 0) & (F.col("level") > 0), F.lag("line").over(turn)))
    deep = deep.withColumn("_taken", (F.col("step") > 0) & (F.coalesce(F.lead("step").over(turn), F.lit(1)) < 0))
    got = deep.where(~F.col("_taken")).select("doc_id", "label", F.when(F.col("step") > 0, F.col("line")).otherwise(F.col("_m")).alias("marker_line"), F.when(F.col("step") < 0, F.col("line")).alias("body_line"))
    return got.withColumn("paired", F.col("marker_line").isNotNull() & F.col("body_line").isNotNull())
