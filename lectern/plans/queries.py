"""Queries over the test tables, one per operator; ``oracles`` holds the SQL they are compared with.

Lines are those of ``doc_lines`` (doc_id is file_id), one row per line, null lines as ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..operators import furniture, hyphens, interface, metrics, notes, regions, render, report, review, verse
from ..operators import lines as L
from ..session import cut
from ..sources import readers
from ..tables import table
from .oracles import oracle_sql as oracle_sql

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def _lines(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "doc_lines").select(F.col("file_id").alias("doc_id"), "line_no", F.coalesce("line", F.lit("")).alias("line"))
    return got.dropDuplicates(["doc_id", "line_no"])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extractions")


# --- scalar functions and projections -----------------------------------------------


@query
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.document_stats(_docs(spark, d))


@query
def lang_token_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", "lang", "text")
    got = L.document_stats(docs).join(docs.select("doc_id", "lang"), "doc_id")
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("word_tokens").alias("word_tokens"), F.sum("characters").alias("characters"), F.sum("line_count").alias("line_count"))


@query
def type_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).where("text is not null").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return words.orderBy(F.desc("n"), "word").limit(100)  # a top-k report


@query
def lines_exploded(spark: SparkSession, d: str) -> DataFrame:
    return L.explode_lines(_docs(spark, d))


@query
def blocks(spark: SparkSession, d: str) -> DataFrame:
    return L.blocks(_lines(spark, d))


@query
def newline_profile(spark: SparkSession, d: str) -> DataFrame:
    got = _docs(spark, d).select(L.newline_style(F.coalesce("headers", F.lit(""))).alias("style"))
    return got.groupBy("style").agg(F.count(F.lit(1)).alias("n"))


@query
def letter_ratio_class(spark: SparkSession, d: str) -> DataFrame:
    return L.usability(_docs(spark, d), "doc_id", "text")


@query
def extraction_class(spark: SparkSession, d: str) -> DataFrame:
    x = _extractions(spark, d).select("extr_id", F.array_join(F.coalesce("text_lines", F.array().cast("array<string>")), "\n").alias("text"), "note").distinct()
    return L.usability(x, "extr_id", "text", producer="note")


@query
def extraction_triage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.triage(extraction_class(spark, d))


@query
def page_number_like(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("page_no", T.page_number(F.col("line"))).where("page_no is not null").select("doc_id", "line_no", "page_no")


@query
def normalised_key_groups(spark: SparkSession, d: str) -> DataFrame:
    got = _lines(spark, d).select("doc_id", T.line_key(F.col("line")).alias("key")).where("key <> ''")
    return got.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    got = _lines(spark, d).where(T.label_shaped(F.col("line"))).select(T.control_key(F.col("line")).alias("key")).where("key <> ''")
    return got.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def roman_numerals(spark: SparkSession, d: str) -> DataFrame:
    """Every word in all lines that is written as a roman numeral, and its value."""
    words = F.regexp_extract_all("line", F.lit(r"[\p{L}\p{M}\p{Nd}_]+"), F.lit(0))
    got = _lines(spark, d).select("doc_id", "line_no", F.posexplode(words).alias("pos", "word")).where(F.col("word").rlike("^[IVXLCDM]+$"))
    return got.withColumn("value", T.roman_value(F.col("word")))


@query
def newline_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Line ends and byte-order marks of the pages as they were sent."""
    raw = _docs(spark, d).where("raw_bytes is not null").select("doc_id", F.hex("raw_bytes").alias("h"), F.octet_length("raw_bytes").alias("source_bytes"))
    octets = F.regexp_replace("h", "(..)", "$1 ")
    crlf = F.regexp_count(octets, F.lit("0D 0A "))
    lf, cr = F.regexp_count(octets, F.lit("0A ")) - crlf, F.regexp_count(octets, F.lit("0D ")) - crlf
    style = F.when((crlf >= lf) & (crlf >= cr), F.lit("CRLF")).when(lf >= cr, F.lit("LF")).otherwise(F.lit("CR"))
    return raw.select("doc_id", "source_bytes", style.alias("newline"), F.col("h").rlike("^(?:EFBBBF|FFFE|FEFF)").alias("had_bom"))


@query
def folded_words(spark: SparkSession, d: str) -> DataFrame:
    got = _lines(spark, d).select("doc_id", F.explode(T.folded_words(F.col("line"))).alias("word")).withColumn("word", F.translate("word", "ς", "σ"))
    return got.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


# --- furniture -----------------------------------------------------------------------


@query
def short_line_series(spark: SparkSession, d: str) -> DataFrame:
    return furniture.series(_lines(spark, d))


@query
def series_gap_stats(spark: SparkSession, d: str) -> DataFrame:
    return furniture.gaps(_lines(spark, d))


@query
def series_judged(spark: SparkSession, d: str) -> DataFrame:
    return furniture.judged(furniture.gaps(_lines(spark, d)))


@query
def ascending_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return furniture.page_numbers(_lines(spark, d))


@query
def near_duplicate_heads(spark: SparkSession, d: str) -> DataFrame:
    return furniture.near_duplicates(_lines(spark, d))


@query
def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    return furniture.find(_lines(spark, d))


@query
def edge_furniture(spark: SparkSession, d: str) -> DataFrame:
    return furniture.edges(_extractions(spark, d))


@query
def page_edges(spark: SparkSession, d: str) -> DataFrame:
    return furniture.page_edges(_extractions(spark, d))


@query
def page_shape(spark: SparkSession, d: str) -> DataFrame:
    return furniture.page_shape(_lines(spark, d))


@query
def document_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Furniture of extractions as an analysis finds it: edges where pages are stated, else inferred, catchwords included."""
    x = _extractions(spark, d).where("kind in ('text', 'ocr')").groupBy(F.col("extr_id").alias("doc_id")).agg(F.max(F.struct("extracted_at", "text_lines", "page_starts")).alias("x")).select("doc_id", "x.text_lines", "x.page_starts")
    lines = x.select("doc_id", F.posexplode("text_lines").alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")
    body = regions.segment(lines).where("label = 'body'").select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    return furniture.in_documents(lines, cut(body), x)


@query
def catchword_pages(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return furniture.catchwords(lines, furniture.find(lines))


@query
def prefix_heads(spark: SparkSession, d: str) -> DataFrame:
    return furniture.prefix_heads(_lines(spark, d))


@query
def head_chapters(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return furniture.head_chapters(furniture.prefix_heads(lines))


# --- regions -------------------------------------------------------------------------


@query
def licence_phrase_density(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", T.phrase_score(t, H.LICENCE).alias("score"), T.phrase_score(t, H.SCANNING).alias("scan_score"))


@query
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(H.is_division(F.col("line"))).select("doc_id", "line_no", H.division_key(F.col("line")).alias("key"))


@query
def numbered_sections(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).where(H.is_section(F.col("line"))).select("doc_id", "line_no", T.strip(F.col("line")).alias("title"))


@query
def front_back_lines(spark: SparkSession, d: str) -> DataFrame:
    got = _lines(spark, d).select("doc_id", "line_no", H.is_front(F.col("line")).alias("is_front"), H.is_back(F.col("line")).alias("is_back"), H.is_metadata(F.col("line")).alias("is_metadata"))
    return got.where("is_front or is_back or is_metadata")


@query
def notice_lines(spark: SparkSession, d: str) -> DataFrame:
    f = regions.features(_lines(spark, d)).select("doc_id", "line_no", "start_mark", "end_mark", "credit", "credit_heading", "contents")
    return f.where("start_mark or end_mark or credit or credit_heading or contents")


@query
def numeral_lines(spark: SparkSession, d: str) -> DataFrame:
    return regions.features(_lines(spark, d)).where("numeral is not null").select("doc_id", "line_no", F.col("numeral").alias("value"))


@query
def split_headings(spark: SparkSession, d: str) -> DataFrame:
    """A division word alone on its line, its number on the next."""
    lines = _lines(spark, d)
    return regions.features(lines).where("division").join(heading_lines(spark, d).select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti").select("doc_id", "line_no", "key")


@query
def region_candidates(spark: SparkSession, d: str) -> DataFrame:
    return regions.candidates(_lines(spark, d))


@query
def notice_blocks(spark: SparkSession, d: str) -> DataFrame:
    return regions.notices(_lines(spark, d))


@query
def region_cover(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return regions.cover(regions.paint(lines, regions.candidates(lines)))


@query
def region_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return regions.segment(_lines(spark, d))


@query
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return regions.gaps(lines, regions.segment(lines))


@query
def coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return regions.coverage(lines, regions.segment(lines))


@query
def apparatus_lines(spark: SparkSession, d: str) -> DataFrame:
    return regions.apparatus(regions.segment(_lines(spark, d)))


@query
def integration_table(spark: SparkSession, d: str) -> DataFrame:
    lines, seg, out = _rendered(spark, d)
    return regions.integration(lines, seg, render.stats(out))


@query
def region_label_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return regions.label_totals(lines, regions.segment(lines))


@query
def region_roll_up(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    seg = cut(regions.segment(lines))
    owned = L.spread(seg, "region_idx")
    words = owned.join(lines, ["doc_id", "line_no"]).groupBy("doc_id", "region_idx").agg(F.sum(F.size(T.words(F.col("line")))).alias("own_words"))
    return regions.roll_up(seg, words)


# --- verse and reflow ----------------------------------------------------------------


@query
def break_profile(spark: SparkSession, d: str) -> DataFrame:
    return verse.profile(_lines(spark, d)).where("authorial").select("doc_id", "line_no", "block_id")


@query
def window_break_rate(spark: SparkSession, d: str) -> DataFrame:
    return verse.rates(_lines(spark, d)).select("doc_id", "line_no", F.round("rate", 6).alias("rate"))


@query
def wrapped_docs(spark: SparkSession, d: str) -> DataFrame:
    return L.wrapped(_lines(spark, d))


@query
def modal_layout(spark: SparkSession, d: str) -> DataFrame:
    return verse.modal_layout(_lines(spark, d))


@query
def double_spaced(spark: SparkSession, d: str) -> DataFrame:
    return verse.double_spaced(_lines(spark, d))


@query
def protected_spans(spark: SparkSession, d: str) -> DataFrame:
    return verse.protected_spans(_lines(spark, d))


@query
def reflow_blocks(spark: SparkSession, d: str) -> DataFrame:
    return verse.reflow(_lines(spark, d))


# --- hyphens and review --------------------------------------------------------------


@query
def hyphen_breaks(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.breaks(_lines(spark, d))


@query
def vocabulary_counts(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.vocabulary(_lines(spark, d)).where("n >= 2")


@query
def hyphen_decisions(spark: SparkSession, d: str) -> DataFrame:
    return hyphens.decisions(_lines(spark, d)).select("doc_id", "line_no", "joined", "hyphenated", "decision")


@query
def hyphen_decisions_extra(spark: SparkSession, d: str) -> DataFrame:
    """With the table of common words as words attested elsewhere."""
    return hyphens.decisions(_lines(spark, d), table(spark, d, "common_words").where("word is not null")).select("doc_id", "line_no", "hyphenated", "decision")


@query
def hyphen_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return hyphens.join_lines(lines, hyphens.decisions(lines))


@query
def review_items(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return review.items(hyphens.decisions(lines), notes.pairs(lines)).drop("examples")


@query
def review_apply(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    decided = hyphens.decisions(lines)
    hints = table(spark, d, "breaks").where("decision in ('join', 'keep')").groupBy(F.col("hyphenated").alias("key")).agg(F.max("decision").alias("decision")).withColumn("kind", F.lit("hyphen"))
    return review.apply(decided, hints).select("doc_id", "line_no", "hyphenated", "decision", "resolved")


@query
def review_outstanding(spark: SparkSession, d: str) -> DataFrame:
    """Undecided breaks that the hints of the table of breaks don't answer either."""
    answered = table(spark, d, "breaks").where("decision in ('join', 'keep')").select(F.lit("hyphen").alias("kind"), F.col("hyphenated").alias("key"), "decision")
    return review.outstanding(review.items(hyphens.decisions(_lines(spark, d))), answered).select("kind", "key", "occurrences")


# --- interface and notes -------------------------------------------------------------


def _thread_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of crawled texts, threads among them; a line "@name · 3 h" is read as two, the handle and the time."""
    docs = _docs(spark, d).select("doc_id", F.regexp_replace("text", r"(?m)^(@[\p{L}\p{Nd}_.]+) · (\d+ [smhdwy])$", "$1\n$2").alias("text"))
    return L.explode_lines(docs)


@query
def interface_records(spark: SparkSession, d: str) -> DataFrame:
    return interface.records(_thread_lines(spark, d)).select("doc_id", "line_no", "record", "is_body")


@query
def interface_label_counts(spark: SparkSession, d: str) -> DataFrame:
    return interface.label_counts(_thread_lines(spark, d)).select("doc_id", "key", "records_with", "records", "confirmed")


@query
def interface_labels(spark: SparkSession, d: str) -> DataFrame:
    return interface.labels(_thread_lines(spark, d))


@query
def footnote_bodies(spark: SparkSession, d: str) -> DataFrame:
    return notes.bodies(_lines(spark, d))


@query
def footnote_markers(spark: SparkSession, d: str) -> DataFrame:
    return notes.markers(_lines(spark, d))


@query
def footnote_pairs(spark: SparkSession, d: str) -> DataFrame:
    return notes.pairs(_lines(spark, d))


# --- readers -------------------------------------------------------------------------


@query
def encoding_detect(spark: SparkSession, d: str) -> DataFrame:
    raw = _docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("raw_bytes").alias("content"))
    return readers.load_bytes(raw).select("name", "encoding", "had_bom", "encoding_confidence", "newline", "source_bytes", "replacement_chars")


@query
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return readers.html_column(_docs(spark, d), "doc_id", "raw_bytes")


@query
def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    whole = _lines(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    files = whole.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.encode("t", "UTF-8").alias("content"))
    return readers.load_bytes(files).select("name", "text", "error")


# --- variants, logs, scores ----------------------------------------------------------


def _rendered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = cut(_lines(spark, d))
    seg = cut(regions.segment(lines))
    return lines, seg, render.render_all(lines, seg)


@query
def variant_text(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d)[2]


@query
def variant_tokens(spark: SparkSession, d: str) -> DataFrame:
    return render.stats(_rendered(spark, d)[2])


@query
def variant_delta(spark: SparkSession, d: str) -> DataFrame:
    return render.deltas(render.stats(_rendered(spark, d)[2]))


@query
def variant_drop_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.dropped(regions.segment(_lines(spark, d)), render.resolve())


@query
def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", render.tidy(F.col("text"), render.BUILTIN["full"]).alias("text"))


@query
def variant_repaired(spark: SparkSession, d: str) -> DataFrame:
    lines = cut(_lines(spark, d))
    seg = cut(regions.segment(lines))
    facts = render.Facts(furniture=cut(furniture.find(lines)), interface=cut(interface.labels(lines)), notes=cut(notes.bodies(lines)), note_pairs=cut(notes.pairs(lines)))
    choice = render.custom("repaired", ["front_matter", "body", "back_matter", "unknown"], drop_furniture=True, drop_interface=True, footnotes="remove", dehyphenate=True, reflow=True)
    return render.render(lines, seg, choice, facts)


@query
def dropped_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    kept = render.kept_lines(lines, regions.segment(lines), render.BUILTIN["body-only"])
    return render.marked(lines, kept)


@query
def invented_lines(spark: SparkSession, d: str) -> DataFrame:
    lines, _, out = _rendered(spark, d)
    return metrics.invented(lines, out)


@query
def verbatim_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """The baseline holds every line with text, and no other."""
    lines = cut(_lines(spark, d))
    return metrics.fidelity(lines, render.render_all(lines, cut(regions.segment(lines)), ["verbatim"]))


@query
def variant_removals(spark: SparkSession, d: str) -> DataFrame:
    lines = cut(_lines(spark, d))
    seg = cut(regions.segment(lines))
    facts = render.Facts(furniture=cut(furniture.find(lines)), interface=cut(interface.labels(lines)), notes=cut(notes.bodies(lines)), note_pairs=cut(notes.pairs(lines)))
    choice = render.custom("repaired", ["front_matter", "body", "back_matter", "unknown"], drop_furniture=True, drop_interface=True, footnotes="remove")
    return render.removals(lines, seg, [*render.resolve(), choice], facts)


@query
def stress_verdict(spark: SparkSession, d: str) -> DataFrame:
    lines, seg, out = _rendered(spark, d)
    return metrics.verdicts(render.deltas(render.stats(out)), regions.gaps(lines, seg))


@query
def accuracy_prf(spark: SparkSession, d: str) -> DataFrame:
    """Broken words found in extractions, held against the lines that an earlier detector noted."""
    x = _extractions(spark, d).where("kind in ('text', 'ocr')")
    lines = x.select(F.col("extr_id").alias("doc_id"), F.posexplode("text_lines").alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), F.coalesce("line", F.lit("")).alias("line")).dropDuplicates(["doc_id", "line_no"])
    noted = table(spark, d, "breaks").join(x.select("extr_id").distinct(), "extr_id", "left_semi").select(F.col("extr_id").alias("doc_id"), "line_no")
    return metrics.sets(noted, hyphens.breaks(lines), ["doc_id", "line_no"])


@query
def furniture_prf(spark: SparkSession, d: str) -> DataFrame:
    """Furniture by the page interval, held against that of stated page edges, over extractions."""
    x = _extractions(spark, d).where("kind in ('text', 'ocr')")
    lines = x.select(F.col("extr_id").alias("doc_id"), F.posexplode("text_lines").alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line").dropDuplicates(["doc_id", "line_no"])
    stated = furniture.edges(x).select("doc_id", "line_no")
    found = furniture.find(lines).join(stated.select("doc_id").distinct(), "doc_id", "left_semi")
    return metrics.sets(stated, found, ["doc_id", "line_no"])


@query
def json_log(spark: SparkSession, d: str) -> DataFrame:
    lines, seg, out = _rendered(spark, d)
    return report.json_log(lines.select("doc_id").distinct(), seg, render.deltas(render.stats(out)), render.dropped(seg, render.resolve()))


@query
def markdown_log(spark: SparkSession, d: str) -> DataFrame:
    lines, seg, out = _rendered(spark, d)
    return report.markdown_log(lines.select("doc_id").distinct(), seg, render.deltas(render.stats(out)), render.dropped(seg, render.resolve()), regions.gaps(lines, seg))


def queries() -> dict[str, Query]:
    return dict(_all)
