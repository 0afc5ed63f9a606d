"""Regions: every line of a document gets exactly one label.

Line features are column expressions; one Python call per document turns them into candidate
regions (what depends on the order of headings has no relational form); painting, the check
of cover and the hierarchy are windows and aggregates again.

Labels: header, licence, front_matter, body, back_matter, unknown.  Positions are 1-based and
inclusive.  Detection never deletes: only a variant (``render``) leaves lines out.
"""

from __future__ import annotations

from collections.abc import Iterator

from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..session import cut
from . import furniture
from .lines import in_order, spread, with_blocks

LABELS = ("header", "licence", "front_matter", "body", "back_matter", "unknown")
PRECEDENCE = {"unknown": 0, "front_matter": 1, "back_matter": 1, "body": 2, "header": 3, "licence": 3}
ZONE, META_ZONE, CONTENTS_GAP, CONTENTS_LEAST, CONTENTS_SHARE = 40, 30, 4, 3, 0.6
LEVELS = 4  # of divisions, and of dotted section numbers
PAGE_HEADINGS, PAGE_HEADS = "headings in front of their pages", "the same head on all pages of a chapter"
OPENING = "(opening, before the first chapter that shows)"
LICENCE_DENSITY, LICENCE_LEAST, ACCURACY = 5.0, 2, 50.0


def features(lines: DataFrame) -> DataFrame:
    """One row per line: which kinds of heading or notice it may be."""
    base = with_blocks(lines)
    s = F.col("s")
    after = F.coalesce(F.lead("s", 1).over(in_order()), F.lit(""))
    after2 = F.coalesce(F.lead("s", 2).over(in_order()), F.lit(""))
    number = F.when(after != "", after).otherwise(after2)
    alone = s.rlike(rf"(?iu)^(?:{H._WORDS})\s*[.:]?$")
    two = alone & number.rlike(rf"(?iu)^{H.NUMBER}\s*[.:]?$")
    return base.select(
        "doc_id", "line_no", "s", "blank", "block_id",
        (H.is_division(s) | two).alias("division"), F.when(two, F.lower(F.concat_ws(" ", F.regexp_replace(s, r"[.:\s]+$", ""), F.regexp_replace(number, r"[.:\s]+$", "")))).otherwise(H.division_key(s)).alias("key"),
        H.is_section(s).alias("section"), F.when(F.length("line") > H.MAX_HEADING, F.nullif(T.strip(F.regexp_extract(F.col("line"), H.PAGE_HEADING, 0)), F.lit(""))).alias("page_heading"), F.when(H.is_numeral(s), T.numeral_value(s)).alias("numeral"), H.is_front(s).alias("front"), H.is_back(s).alias("back"),
        H.is_metadata(s).alias("metadata"), s.rlike(H.CONTENTS).alias("contents"), s.rlike(H.START_MARK).alias("start_mark"), s.rlike(H.END_MARK).alias("end_mark"),
        s.rlike(H.CREDIT).alias("credit"), s.rlike(H.CREDIT_HEADING).alias("credit_heading"),
    )


def notices(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, kind, score): blocks of licence text, digitisation notices and
    pages that the scanner itself calls unreadable.
    """
    full = with_blocks(lines).where(~F.col("blank"))
    # only blocks that can hold a phrase are put together
    hint = F.lower("s").rlike("gutenberg|archive|domain|restrictions|redistribution|ebook|copy it|trademark|epub|optical|scanned|google|query|attribution|accurate|original from|digital copy")
    some = full.where(hint).select("doc_id", "block_id").distinct()
    text = full.join(some, ["doc_id", "block_id"], "left_semi").groupBy("doc_id", "block_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ").alias("t"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )
    words = F.size(F.split(F.col("t"), r"\s+"))
    lic, scan, acc = T.phrase_score(F.col("t"), H.LICENCE), T.phrase_score(F.col("t"), H.SCANNING), H.stated_accuracy(F.col("t"))
    named = F.lower("t").rlike("gutenberg|pglaf")
    kind = F.when(acc < ACCURACY, F.lit("ocr_rejected")).when(scan >= 1, F.lit("scan_apparatus")).when((lic >= LICENCE_LEAST) & named & (lic * 1000.0 / words >= LICENCE_DENSITY), F.lit("licence_block"))
    return text.select("doc_id", "first_line", "last_line", kind.alias("kind"), F.when(kind == "scan_apparatus", scan).otherwise(lic).alias("score"), F.round(lic * 1000.0 / words, 3).alias("density")).where("kind is not null")


BESIDE = 2  # lines from a page's heading within which a running head is of its chapter


def _page_tier(inside: list[dict], series: list[dict], skip) -> dict[int, str]:
    """Chapters of a document with a page to each line: line -> title.

    They show in two ways, each damaged in its own: a heading run into the text of its page, and a
    running head on every page of the chapter.  Both count; a series of heads that begins at or soon
    after a heading is that heading's chapter.
    """
    found = {r["n"]: r["page_heading"] for r in inside if r["page_heading"]}
    at = sorted(found)
    near = max(BESIDE, int(median(b - a for a, b in zip(at, at[1:]))) // 2) if len(at) > 1 else BESIDE
    for x in sorted(series, key=lambda x: x["first_line"]):
        n = x["first_line"]
        if not skip(n) and not any(0 <= n - j <= near for j in found):
            found[n] = x["title"]
    return found if len(found) >= 3 else {}


def _tier(rows: list[dict], lo: int, hi: int, skip, paged: bool = False, series: list[dict] = ()) -> tuple[list[int], str, str, dict[int, str]]:
    """The headings of the first kind that the document has any of: lines, kind, evidence, titles."""
    inside = [r for r in rows if lo <= r["n"] <= hi and not skip(r["n"])]
    found = [r["n"] for r in inside if r["division"]]
    if found:
        return found, "chapter", "a division word and its number", {}
    if paged and (titles := _page_tier(inside, [x for x in series if lo <= x["first_line"] <= hi], skip)):
        return sorted(titles), "chapter", PAGE_HEADINGS if any(r["page_heading"] and r["n"] in titles for r in inside) else PAGE_HEADS, titles
    found = [r["n"] for r in inside if r["section"]]
    first = next((r["s"] for r in inside if r["section"]), "")
    if len(found) >= 2 and first.split(".")[0].split(" ")[0] == "1":
        return found, "section", "section numbers", {}
    best: list[int] = []
    run: list[int] = []
    for r in inside:
        if r["numeral"] is None or not 1 <= r["numeral"] <= 200:
            continue
        if r["numeral"] == len(run) + 1:
            run.append(r["n"])
        elif r["numeral"] == 1:
            best, run = (run if len(run) > len(best) else best), [r["n"]]
    best = run if len(run) > len(best) else best
    return (best, "chapter", "numerals that count up, alone on their lines", {}) if len(best) >= 3 else ([], "", "", {})


def _contents(heads: list[int], key: dict[int, str], full: list[int]) -> int:
    """How many of the opening headings are a list of contents."""
    run = len(heads)
    for k in range(1, len(heads)):
        if heads[k] - heads[k - 1] > CONTENTS_GAP:
            run = k
            break
    if run < CONTENTS_LEAST or run >= len(heads):
        return 0
    later = {key[h] for h in heads[run:]}
    hits = sum(key[h] in later for h in heads[:run])
    between = sum(heads[0] < n < heads[run - 1] for n in full) - (run - 2)
    return run if hits >= CONTENTS_SHARE * run or between <= run // 4 and hits >= max(2, run // 4) else 0


def assemble(n: int, rows: list[dict], full: list[int], found: list[dict], paged: bool = False, series: list[dict] = ()) -> list[tuple]:
    """Candidate regions of one document: (label, kind, title, first, last, confidence, evidence), in order of emission."""
    out: list[tuple] = []
    by = {r["n"]: r for r in rows}
    lo, hi = 1, n
    start = next((r["n"] for r in rows if r["start_mark"]), None)
    end = next((r["n"] for r in reversed(rows) if r["end_mark"]), None)
    if start is not None:
        out.append(("header", "pg_header", "Header", 1, start, 1.0, "the mark where the text starts"))
        lo = start + 1
    if end is not None and end >= lo:
        out.append(("licence", "pg_footer", "Licence", end, n, 1.0, "the mark where the text ends"))
        hi = end - 1
    away: list[tuple[int, int]] = []
    for kind in ("licence_block", "ocr_rejected", "scan_apparatus"):
        for b in found:
            if b["kind"] != kind or not lo <= b["first_line"] <= hi or kind == "licence_block" and start is not None and end is not None or any(a <= b["first_line"] <= z for a, z in away):
                continue
            sure = min(1.0, 0.5 + 0.15 * b["score"]) if kind == "licence_block" else 1.0 if kind == "ocr_rejected" else 0.95
            away.append((b["first_line"], b["last_line"]))
            out.append(("licence", kind, kind.replace("_", " ").capitalize(), *away[-1], sure, f"{b['score']} phrases"))
    blocks: list[tuple[int, int]] = []
    for x in full:
        if lo <= x <= hi:
            if blocks and blocks[-1][1] == x - 1:
                blocks[-1] = (blocks[-1][0], x)
            else:
                blocks.append((x, x))
    notes: list[tuple[int, int]] = []
    for k, (a, z) in enumerate(blocks):
        r = by.get(a)
        if r and r["credit_heading"]:
            notes.append((a, blocks[k + 1][1] if a == z and k + 1 < len(blocks) else z))
    for za, zz in ((lo, min(hi, lo + ZONE - 1)), (max(lo, hi - ZONE + 1), hi)):
        for a, z in blocks:
            a, z = max(a, za), min(z, zz)
            if a <= z and by.get(a, {}).get("credit") and not any(s <= a <= e for s, e in notes):
                notes.append((a, z))
    for a, z in notes:
        away.append((a, z))
        out.append(("header", "transcriber_note", by[a]["s"][:60], a, z, 0.9, "a credit near the start or the end"))
    gone = lambda i: any(a <= i <= z for a, z in away)
    # consecutive "Key: value" lines in the opening
    meta, first, limit = None, None, min(hi, lo + META_ZONE - 1)
    for i in [x for x in full if lo <= x <= limit]:
        if by.get(i, {}).get("metadata"):
            first = i if first is None else first
        else:
            if first is not None and i - first >= 2:
                meta = (first, i - 1)
                break
            first = None
    if meta is None and first is not None and limit - first + 1 >= 2:
        meta = (first, limit)
    if meta:
        out.append(("front_matter", "metadata", "Metadata header", *meta, 0.85, "lines of keys and values"))
    heads, kind, evidence, titles = _tier(rows, lo, hi, gone, paged, series)
    k = _contents(heads, {h: by[h]["key"] for h in heads}, full) if heads and not titles else 0
    contents = None
    if k:
        a, seen = heads[0], 0
        for i in reversed([x for x in full if lo <= x < heads[0]]):
            seen += 1
            if seen > 8:
                break
            if by.get(i, {}).get("contents"):
                a = i
                break
        contents = (a, heads[k - 1])
        out.append(("front_matter", "contents", "Contents", *contents, 0.8, f"{k} headings that come again"))
        heads = heads[k:]
    if not heads:
        rest = meta[1] + 1 if meta else lo
        if rest <= hi:
            out.append(("body", "body", "(whole text)", rest, hi, 0.4, "nothing divides the text"))
        return out
    # series of heads may be missing, so nothing before the first one is taken for front matter
    opening = meta[1] + 1 if meta else lo
    if titles and opening < heads[0]:
        heads, titles = [opening, *heads], {opening: OPENING} | titles
    body = heads[0]
    if body > lo:
        fronts = [i for i in range(lo, body) if by.get(i, {}).get("front") and not gone(i) and not (contents and contents[0] <= i <= contents[1])]
        edge = fronts[0] if fronts else body
        spans = [(lo, meta[0] - 1), (meta[1] + 1, edge - 1)] if meta and lo <= meta[0] < edge else [(lo, edge - 1)]
        for a, z in spans:
            own = [x for x in full if a <= x <= z]
            if own:
                out.append(("front_matter", "titlepage", by.get(own[0], {}).get("s") or "Title page", own[0], own[-1], 0.8, "it stands before the first heading"))
        for j, f in enumerate(fronts):
            out.append(("front_matter", by[f]["s"].lower().replace(" ", "_"), by[f]["s"], f, (fronts[j + 1] if j + 1 < len(fronts) else body) - 1, 0.9, "a title of front matter"))
    back = next((r["n"] for r in rows if r["back"] and body <= r["n"] <= hi and not gone(r["n"])), None)
    stop = back - 1 if back is not None else hi
    starts = [h for h in heads if h <= stop]
    for j, h in enumerate(starts):
        z = min(starts[j + 1] - 1 if j + 1 < len(starts) else stop, stop)
        out.append(("body", kind, titles.get(h) or by[h]["s"], h, z, 1.0 if kind == "chapter" else 0.85, evidence))
    if back is not None:
        out.append(("back_matter", "back_matter", by[back]["s"], back, hi, 0.7, "a title of back matter"))
    return out


_CANDIDATES = "ord int, label string, kind string, title string, first_line int, last_line int, confidence double, evidence string"


def candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, label, kind, title, first_line, last_line, confidence, evidence): may overlap."""
    lines = cut(lines)  # looked at by several rules
    f = features(lines)
    flags = ["division", "section", "front", "back", "metadata", "contents", "start_mark", "end_mark", "credit", "credit_heading"]
    any_flag = F.col("numeral").isNotNull() | F.col("page_heading").isNotNull()
    for c in flags:
        any_flag = any_flag | F.col(c)
    row = F.struct(F.col("line_no").alias("n"), "s", "key", "numeral", "page_heading", *flags)
    opener = F.coalesce(F.lag("blank").over(in_order()), F.lit(True)) & ~F.col("blank")  # first lines of blocks give titles
    per = f.withColumn("_take", any_flag | opener).groupBy("doc_id").agg(
        F.max("line_no").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_take"), row))).alias("rows"), F.array_sort(F.collect_list(F.when(~F.col("blank"), F.col("line_no")))).alias("full")
    )
    found = notices(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "last_line", "kind", "score"))).alias("found"))
    pages = cut(furniture.page_per_line(lines))
    heads = furniture.prefix_heads(lines.join(pages, "doc_id", "left_semi"), gate=False)
    first = heads.groupBy("doc_id", "series").agg(F.min_by("prefix", "line_no").alias("title"))
    chapters = furniture.head_chapters(heads).join(first, ["doc_id", "series"]).groupBy("doc_id").agg(F.collect_list(F.struct("first_line", T.strip(F.col("title")).alias("title"))).alias("series"))
    joined = per.join(found, "doc_id", "left").join(pages.withColumn("paged", F.lit(True)), "doc_id", "left").join(chapters, "doc_id", "left").select("doc_id", "n", "rows", "full", "found", F.coalesce("paged", F.lit(False)).alias("paged"), "series")
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, n, rows, full, found_, paged, series in zip(*(batch.column(i).to_pylist() for i in range(7))):
                out += [(d, k, *c) for k, c in enumerate(assemble(n, rows, full, found_ or [], paged, series or []))]
            cols = list(zip(*out)) if out else [()] * 9
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "ord", "label", "kind", "title", "first_line", "last_line", "confidence", "evidence"])

    return joined.mapInArrow(run, f"doc_id {kind}, {_CANDIDATES}")


def paint(lines: DataFrame, cand: DataFrame) -> DataFrame:
    """Each line with text gets the candidate of highest (precedence, start, order): (doc_id, line_no, ord, label, kind, title, confidence, evidence).

    Lines no candidate covers are ``unknown`` (ord -1).  The interval join is an equi-join on
    (doc_id, line_no) after the intervals are spread, so no theta join is planned.
    """
    prec = F.create_map(*[x for k, v in PRECEDENCE.items() for x in (F.lit(k), F.lit(v))])
    spans = cand.where("first_line <= last_line").withColumn("_top", F.struct(prec[F.col("label")].alias("p"), "first_line", "ord", "label", "kind", "title", "confidence", "evidence"))
    spans = spans.select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no"), "_top")
    owner = spans.groupBy("doc_id", "line_no").agg(F.max("_top").alias("o"))
    full = lines.withColumn("_b", T.strip(F.coalesce("line", F.lit(""))) == "")
    got = full.join(owner, ["doc_id", "line_no"], "left")
    return got.select(
        "doc_id", "line_no", F.col("_b").alias("blank"), F.coalesce("o.ord", F.when(~F.col("_b"), F.lit(-1))).alias("ord"), F.coalesce("o.label", F.when(~F.col("_b"), F.lit("unknown"))).alias("label"),
        F.coalesce("o.kind", F.lit("unclassified")).alias("kind"), F.coalesce("o.title", F.lit("")).alias("title"), F.coalesce("o.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("o.evidence", F.lit("claimed by no rule")).alias("evidence"),
        F.col("o.first_line").alias("own_first"),
    )


def cover(painted: DataFrame) -> DataFrame:
    """The flat cover: runs of lines of one candidate, trimmed to text, in order.

    (doc_id, region_idx, label, kind, title, first_line, last_line, confidence, evidence)
    """
    change = F.coalesce((F.col("ord") != F.lag("ord").over(in_order())) | (F.col("ord").isNull() != F.lag(F.col("ord").isNull()).over(in_order())), F.lit(True))
    runs = painted.withColumn("_g", F.sum(change.cast("int")).over(in_order())).where("ord is not null")
    trimmed = runs.groupBy("doc_id", "_g", "ord").agg(
        *[F.first(c).alias(c) for c in ("label", "kind", "title", "confidence", "evidence", "own_first")], F.min(F.when(~F.col("blank"), F.col("line_no"))).alias("first_line"), F.max(F.when(~F.col("blank"), F.col("line_no"))).alias("last_line")
    ).where("first_line is not null")
    # a part that doesn't start where its candidate does is its continuation
    lead = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("first_line"))
    title = F.when((F.col("ord") >= 0) & F.col("kind").isin("chapter", "section") & (lead > 1), F.concat("title", F.lit(" (continued)"))).otherwise(F.col("title"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1
    return trimmed.withColumn("title", title).select("doc_id", idx.alias("region_idx"), "label", "kind", "title", "first_line", "last_line", "confidence", "evidence")


def hierarchy(regions: DataFrame) -> DataFrame:
    """Adds ``level`` and ``parent`` (region_idx): divisions of a higher rank hold those of a lower one.

    The parent is the nearest region before, since the last one that is no division, of a lower level.
    """
    by = Window.partitionBy("doc_id").orderBy("region_idx")
    number = F.regexp_extract("title", r"^([0-9]+(?:\.[0-9]+)*)", 1)
    rank = F.when(F.col("kind") == "chapter", H.division_rank(F.regexp_replace("title", r" \(continued\)$", ""))).when(F.col("kind") == "section", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    per = Window.partitionBy("doc_id")
    ranked = regions.withColumn("_rank", F.when(F.col("label") == "body", rank))
    kinds = F.size(F.array_distinct(F.collect_set("_rank").over(per)))
    smaller = F.size(F.filter(F.collect_set("_rank").over(per), lambda r: r < F.col("_rank")))
    leveled = ranked.withColumn("level", F.when(F.col("_rank").isNull() | (kinds <= 1), F.lit(1)).otherwise(smaller + 1).cast("int")).withColumn("_seg", F.sum(F.col("_rank").isNull().cast("int")).over(by))
    near = Window.partitionBy("doc_id", "_seg").orderBy("region_idx").rowsBetween(Window.unboundedPreceding, -1)
    idx = lambda lv: F.last(F.when(F.col("_rank").isNotNull() & (F.col("level") == lv), F.col("region_idx")), ignorenulls=True).over(near)
    below = lambda lv: F.greatest(*[idx(k) for k in range(1, lv)], F.lit(None).cast("int"))
    parent = F.coalesce(*[F.when(F.col("_rank").isNotNull() & (F.col("level") == lv), below(lv)) for lv in range(2, LEVELS + 1)])
    return leveled.withColumn("parent", parent.cast("int")).drop("_rank", "_seg")


def segment(lines: DataFrame) -> DataFrame:
    """Regions with their hierarchy."""
    return hierarchy(cover(paint(lines, candidates(lines))))


def gaps(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line): lines with text that no region covers; empty by construction."""
    covered = spread(regions).distinct()
    open_ = lines.where(T.strip(F.coalesce("line", F.lit(""))) != "").join(covered, ["doc_id", "line_no"], "left_anti")
    island = F.col("line_no") - F.row_number().over(in_order())
    return open_.withColumn("_g", island).groupBy("doc_id", "_g").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("_g")


def label_totals(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, label, regions, line_count, words) of each document."""
    owned = regions.select("doc_id", "region_idx", "label", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
    words = F.size(T.words(F.coalesce("line", F.lit(""))))
    return owned.join(lines, ["doc_id", "line_no"]).withColumn("_w", words).groupBy("doc_id", "label").agg(F.countDistinct("region_idx").cast("int").alias("regions"), F.count(F.lit(1)).alias("line_count"), F.sum("_w").alias("words"))


def roll_up(regions: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, region_idx, own_words, total_words): words of a region and of all below it (there are at most ``LEVELS``)."""
    own = cut(regions.select("doc_id", "region_idx", "parent").join(words.select("doc_id", "region_idx", "own_words"), ["doc_id", "region_idx"], "left").na.fill(0, ["own_words"]))
    up = own.select("doc_id", F.col("region_idx").alias("holder"), F.col("parent").alias("_up")).hint("merge")
    holds = level = own.select("doc_id", "region_idx", "own_words", F.col("region_idx").alias("holder"))
    for _ in range(LEVELS - 1):
        level = level.join(up, ["doc_id", "holder"]).where("_up is not null").select("doc_id", "region_idx", "own_words", F.col("_up").alias("holder"))
        holds = holds.unionByName(level)
    total = holds.groupBy("doc_id", F.col("holder").alias("region_idx")).agg(F.sum("own_words").alias("total_words")).hint("merge")
    return own.select("doc_id", "region_idx", "own_words").join(total, ["doc_id", "region_idx"])


def apparatus(regions: DataFrame) -> DataFrame:
    """(doc_id, line_no): lines of headers and licences, which no other rule looks at."""
    return regions.where("label in ('header', 'licence')").select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no")).distinct()


def masked(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines with those of headers and licences blank."""
    gone = apparatus(regions).withColumn("_gone", F.lit(True))
    return lines.join(gone, ["doc_id", "line_no"], "left").withColumn("line", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("line"))).drop("_gone")


def coverage(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, text_lines, covered_once): lines with text, and those of them that exactly one region covers."""
    held = regions.select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no")).groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("_k"))
    full = lines.where(T.strip(F.coalesce("line", F.lit(""))) != "").join(held, ["doc_id", "line_no"], "left")
    return full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("text_lines"), F.sum((F.coalesce("_k", F.lit(0)) == 1).cast("int")).alias("covered_once"))


def integration(lines: DataFrame, regions: DataFrame, measured: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A table for looking over a corpus: (doc_id, text_lines, median_length, page_per_line, regions, chapters, evidence,
    verbatim_tokens, body_tokens, body_percent[, expected, exact]).  ``expected``: (doc_id, chapters) where known.
    """
    shape = furniture.page_shape(lines).drop("cv")
    own = regions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("regions"), F.sum(((F.col("label") == "body") & ~F.endswith("title", F.lit("(continued)"))).cast("int")).alias("chapters"), F.min_by(F.when(F.col("label") == "body", F.col("evidence")), F.when(F.col("label") == "body", F.col("region_idx"))).alias("evidence")
    )
    words = measured.groupBy("doc_id").agg(*[F.max(F.when(F.col("variant") == v, F.col("word_tokens"))).alias(c) for v, c in (("verbatim", "verbatim_tokens"), ("body-only", "body_tokens"))])
    got = own.join(shape, "doc_id", "left").join(words, "doc_id", "left").withColumn("body_percent", F.when(F.col("verbatim_tokens") > 0, F.round(100.0 * F.col("body_tokens") / F.col("verbatim_tokens"), 1)).otherwise(F.lit(0.0)))
    if expected is None:
        return got
    return got.join(expected.select("doc_id", F.col("chapters").alias("expected")), "doc_id", "left").withColumn("exact", F.col("chapters") == F.col("expected"))
