"""Words broken at line ends: breaks, the document's own vocabulary, decisions and joining.

A break is decided by what the document itself attests elsewhere: a word counts as attested
if it occurs more often than as a fragment of breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTER
from .lines import in_order

CHAR = rf"{LETTER}\p{{M}}\p{{Nd}}_"  # characters of a word
TAIL = rf"([{LETTER}][{CHAR}'’-]*)-[\s]*$"
HEAD = rf"^\s*([{LETTER}][{CHAR}'’]*)"
VOCABULARY = rf"[{LETTER}][{CHAR}'’-]*"
SUFFIX = 3  # an unattested tail of up to so many letters is a suffix


def fold(text: str) -> Column:
    """Lower case, with one form of the letter sigma wherever it stands."""
    return F.translate(F.lower(text), "ς", "σ")


def breaks(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, left_part, right_part, joined, hyphenated): a line ends in a hyphen attached
    to a word, and the next physical line opens with a word.
    """
    after = F.lead("line").over(in_order())
    left, right = F.regexp_extract("line", TAIL, 1), F.regexp_extract("_next", HEAD, 1)
    got = lines.withColumn("_next", after).where(F.col("line").rlike(TAIL) & F.col("_next").rlike(HEAD))
    got = got.select("doc_id", "line_no", left.alias("left_part"), right.alias("right_part"))
    return got.withColumns({"joined": F.concat("left_part", "right_part"), "hyphenated": F.concat_ws("-", "left_part", "right_part")})


def vocabulary(lines: DataFrame) -> DataFrame:
    """(doc_id, word, n): lower-cased words, inner hyphens and apostrophes kept, edge hyphens not."""
    words = lines.select("doc_id", F.explode(F.regexp_extract_all(fold("line"), F.lit(VOCABULARY), F.lit(0))).alias("word"))
    words = words.select("doc_id", F.regexp_replace("word", "^-+|-+$", "").alias("word")).where("word <> ''")
    return words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def decisions(lines: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """:func:`breaks` with ``decision`` (join, keep, unknown) and ``reason``.

    ``extra``: a table of further attested words (word), e.g. a word list.
    """
    found = breaks(lines)
    fragments = found.select("doc_id", F.explode(F.array(fold("left_part"), fold("right_part"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("f"))
    attested = vocabulary(lines).join(fragments, ["doc_id", "word"], "left").where(F.col("n") > F.coalesce("f", F.lit(0))).select("doc_id", "word", F.lit(True).alias("_own"))
    roles = F.posexplode(F.array(*[fold(c) for c in ("joined", "hyphenated", "left_part", "right_part")])).alias("_role", "word")
    asked = found.select("*", roles).join(attested, ["doc_id", "word"], "left")
    if extra is not None:
        asked = asked.join(extra.select(fold("word").alias("word"), F.lit(True).alias("_x")).distinct(), "word", "left").withColumn("_own", F.coalesce("_own", "_x"))
    yes = lambda k: F.coalesce(F.max(F.when(F.col("_role") == k, F.col("_own"))), F.lit(False))
    out = asked.groupBy("doc_id", "line_no", "left_part", "right_part", "joined", "hyphenated").agg(yes(0).alias("_joined"), yes(1).alias("_hyphenated"), yes(2).alias("_left_part"), yes(3).alias("_right_part"))
    return out.withColumns({"decision": _decide("decision"), "reason": _decide("reason")}).drop("_joined", "_hyphenated", "_left_part", "_right_part")


def _decide(what: str) -> Column:
    pick = lambda decision, reason: F.lit(decision if what == "decision" else reason)
    return (
        F.when(F.col("_joined"), pick("join", "seen joined elsewhere"))
        .when(F.col("_hyphenated"), pick("keep", "seen hyphenated elsewhere"))
        .when(~F.col("_left_part"), pick("join", "left is no word of the text"))
        .when(F.col("_right_part"), pick("keep", "both parts are words of the text"))
        .when(F.length("right_part") <= SUFFIX, pick("join", "right is a suffix"))
        .otherwise(pick("unknown", "no evidence either way"))
    )


def join_lines(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines with decided breaks closed: consecutive breaks are islands, folded in line order.

    The word goes to the line it began on; lines that become empty are left out.
    """
    d = decided.where("decision in ('join', 'keep')").select("doc_id", "line_no", "left_part", F.coalesce(*(["resolved"] if "resolved" in decided.columns else []), F.when(F.col("decision") == "join", F.col("joined")).otherwise(F.col("hyphenated"))).alias("_word"))
    marked = lines.join(d, ["doc_id", "line_no"], "left")
    opens = F.col("_word").isNotNull()
    after = F.coalesce(F.lag(opens).over(in_order()), F.lit(False))
    island = F.sum((~after).cast("int")).over(in_order())
    grouped = marked.withColumn("_g", island).groupBy("doc_id", "_g").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "left_part", "_word"))).alias("_rows"))
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("cut"))

    def fold(acc: Column, row: Column) -> Column:
        # what the line adds: without the fragment an earlier line took
        own = F.when(acc["cut"] != "", F.regexp_replace(row["line"], rf"^\s*[{LETTER}][{CHAR}'’]*", "")).otherwise(row["line"])
        whole = F.concat(acc["text"], own)
        tail = F.concat(row["left_part"], F.lit("-"))
        trimmed = F.regexp_replace(whole, r"\s+$", "")
        closed = F.concat(F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(tail)), row["_word"])
        merges = row["_word"].isNotNull() & F.coalesce(F.endswith(F.regexp_replace(whole, r"\s+$", ""), tail), F.lit(False))
        return F.struct(F.when(merges, closed).otherwise(whole).alias("text"), F.when(merges, F.lit("x")).otherwise(F.lit("")).alias("cut"))

    text = F.aggregate("_rows", start, fold, lambda a: a["text"])
    return grouped.select("doc_id", F.element_at("_rows", 1)["line_no"].alias("line_no"), text.alias("line"))
