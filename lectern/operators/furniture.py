"""Page furniture: lines that recur at the page interval, edges of stated pages, catchwords,
running heads set before the text of a page.

Grouping, gaps and judgement are aggregates and windows; only what has no relational form
(likeness of damaged heads, the longest rising run of page numbers) runs in Python, on one
row per series of a document.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..session import cut
from .lines import in_order

MAX_LEN, LEAST, MAX_CV, TOLERANCE = 60, 5, 0.25, 0.25
ALIKE_LINES, ALIKE_PREFIXES = 0.85, 0.80
CATCH_WORDS, CATCH_LEN, CATCH_PAGES, CATCH_RATE = 3, 30, 4, 0.35
PREFIX_LEAST, EDGE_LEAST = 3, 3


def keyed(lines: DataFrame) -> DataFrame:
    """Short lines with the ``key`` by which they group; page numbers are one group."""
    s = T.strip(F.coalesce("line", F.lit("")))
    got = lines.withColumn("s", s).where((F.col("s") != "") & (F.length("s") <= MAX_LEN))
    number = F.when(F.col("s").rlike("[0-9]"), T.page_number(F.col("s")))
    got = got.withColumn("page_no", number).withColumn("key", F.when(number.isNotNull(), F.lit("#")).otherwise(T.line_key(F.col("s"))))
    return got.where("key <> ''").select("doc_id", "line_no", "s", "key", "page_no")


def series(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, key, n, first_line, is_numeric): groups with at least ``least`` lines."""
    groups = keyed(lines).groupBy("doc_id", "key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("line_no").alias("first_line"))
    return groups.where(F.col("n") >= least).withColumn("is_numeric", F.col("key") == "#")


def _distances(members: DataFrame, least: int) -> DataFrame:
    """:func:`gaps` of lines (doc_id, key, line_no), from one shuffle."""
    by = Window.partitionBy("doc_id", "key").orderBy("line_no")
    steps = members.withColumn("gap", F.col("line_no") - F.lag("line_no").over(by))
    got = steps.groupBy("doc_id", "key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.median("gap").alias("median_gap"), F.count("gap").alias("_k"), F.stddev_pop("gap").alias("_sd"), F.avg("gap").alias("_mean"))
    cv = F.when((F.col("_k") >= 2) & (F.col("_mean") != 0), F.round(F.col("_sd") / F.col("_mean"), 6))
    return got.where(F.col("n") >= least).select("doc_id", "key", "n", "median_gap", cv.alias("cv"))


def gaps(lines: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, key, n, median_gap, cv) over the distances of each series' consecutive lines."""
    return _distances(keyed(lines).select("doc_id", "key", "line_no"), least)


def _fits(gap: Column, page: Column) -> Column:
    """The distance is about one, two or three pages."""
    ratio = gap / page
    return F.greatest(*[(F.abs(ratio - k) <= TOLERANCE).cast("int") for k in (1, 2, 3)]) == 1


def judged(stats: DataFrame) -> DataFrame:
    """:func:`gaps` with the page length (of the steadiest numeric series) and ``accepted``.

    Without a steady series of page numbers nothing is accepted.
    """
    numeric = stats.where((F.col("key") == "#") & (F.col("cv") < MAX_CV))
    page = numeric.groupBy("doc_id").agg(F.min_by("median_gap", F.struct("cv", -F.col("n"))).alias("page_length"))
    got = stats.join(page, "doc_id", "left")
    good = F.col("page_length").isNotNull() & (F.col("cv") < MAX_CV) & _fits(F.col("median_gap"), F.col("page_length"))
    return got.withColumn("accepted", F.coalesce(good, F.lit(False)))


def longest_rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence (patience sorting; the earliest end wins)."""
    tails: list[int] = []
    at: list[int] = []
    prev = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        prev[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = prev[i]
    return out[::-1]


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def rising(values: pd.Series) -> pd.Series:
    """For each array: 0-based positions of its longest rising subsequence."""
    return values.map(lambda v: longest_rising([int(x) for x in v]) if v is not None else None)


def page_numbers(lines: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, page_no): the page numbers that rise through the document, at least five."""
    numbers = (keyed(lines) if short is None else short).where("page_no is not null")
    rows = numbers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "page_no"))).alias("_r")).where(F.size("_r") >= LEAST)
    kept = rows.withColumn("_i", rising(F.transform("_r", lambda x: x["page_no"]))).where(F.size("_i") >= LEAST)
    return kept.select("doc_id", F.explode(F.transform("_i", lambda i: F.element_at("_r", i + 1))).alias("x")).select("doc_id", "x.line_no", "x.page_no")


def alike(a: str, b: str, least: float) -> bool:
    """The longest-block likeness of two texts is at least ``least``; cheap bounds first."""
    whole = least * (len(a) + len(b)) / 2
    if min(len(a), len(b)) < whole:
        return False
    if len(b) - len(b.translate(dict.fromkeys(map(ord, a)))) < whole or len(a) - len(a.translate(dict.fromkeys(map(ord, b)))) < whole:
        return False  # too few characters in common
    return difflib.SequenceMatcher(None, a, b).ratio() >= least


def _merge(keys: list[str], sizes: list[int], least: float, factor: int) -> list[int]:
    """For each key the position of the key it merges into: larger series take in like, much smaller ones."""
    home = list(range(len(keys)))
    order = sorted(range(len(keys)), key=lambda i: (-sizes[i], i))
    for a in order:
        if sizes[a] < factor:
            break  # no smaller series is small enough
        if home[a] != a:
            continue
        for b in reversed(order):
            if factor * sizes[b] > sizes[a]:
                break
            if home[b] == b and alike(keys[a], keys[b], least):
                home[b] = a
    return home


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def _merged(keys: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_merge(list(k), [int(x) for x in n], ALIKE_LINES, 3) for k, n in zip(keys, sizes)])


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def _merged_prefixes(keys: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([_merge(list(k), [int(x) for x in n], ALIKE_PREFIXES, 2) for k, n in zip(keys, sizes)])


def near_duplicates(lines: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, merged_into, n): keys of short lines seen at least twice or like one that is,
    damaged forms merged into the frequent form they resemble.
    """
    groups = (keyed(lines) if short is None else short).where("key <> '#'").groupBy("doc_id", "key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("line_no").alias("first_line"))
    big = groups.groupBy("doc_id").agg(F.max("n").alias("m")).where("m >= 3").select("doc_id")
    rows = groups.join(big, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_line", "key", "n"))).alias("_r"))
    home = rows.withColumn("_h", _merged(F.transform("_r", lambda x: x["key"]), F.transform("_r", lambda x: x["n"])))
    flat = home.select("doc_id", "_r", F.posexplode("_h").alias("i", "h"))
    return flat.select("doc_id", F.element_at("_r", F.col("i") + 1)["key"].alias("key"), F.element_at("_r", F.col("h") + 1)["key"].alias("merged_into"), F.element_at("_r", F.col("i") + 1)["n"].alias("n"))


def find(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, rule): inferred page furniture: group, merge like keys, take rising numbers, judge."""
    short = cut(keyed(lines))
    alias = near_duplicates(lines, short).where("key <> merged_into").select("doc_id", "key", "merged_into")
    rows = short.where("key <> '#'").join(alias, ["doc_id", "key"], "left").select("doc_id", "line_no", F.coalesce("merged_into", "key").alias("key"))
    members = cut(rows.unionByName(page_numbers(lines, short).select("doc_id", "line_no", F.lit("#").alias("key"))))
    taken = judged(_distances(members, LEAST)).where("accepted").select("doc_id", "key").hint("merge")  # the other side would be broadcast, all short lines
    return members.join(taken, ["doc_id", "key"]).select("doc_id", "line_no", F.when(F.col("key") == "#", F.lit("page_number")).otherwise(F.lit("running_head")).alias("rule"))


def in_documents(lines: DataFrame, body: DataFrame, paged: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, rule): the furniture of segmented documents, catchwords included.

    ``body``: (doc_id, line_no) of body lines; front and back matter have their own conventions and are left
    alone.  ``paged``: (doc_id, text_lines, page_starts); where at least three page starts are stated, the edges of
    these pages are judged (rules head and foot) and nothing is inferred.
    """
    own = lines.join(body.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
    stated = None
    if paged is not None:
        some = paged.where(F.size("page_starts") >= EDGE_LEAST)
        stated = edges(some, "doc_id").select("doc_id", "line_no", F.col("edge").alias("rule")).join(body.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_semi")
        own = own.join(some.select("doc_id").distinct(), "doc_id", "left_anti")
    own = cut(own)
    inferred = cut(find(own))
    catch = catchwords(own, inferred).where("accepted").select("doc_id", "line_no", F.lit("catchword").alias("rule"))
    got = inferred.unionByName(catch)
    got = got if stated is None else got.unionByName(stated)
    return got.groupBy("doc_id", "line_no").agg(F.min("rule").alias("rule"))


def catchwords(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(doc_id, line_no, s, opens, accepted): the last line before a page boundary that repeats how
    the next page opens.  ``boundaries``: furniture lines (doc_id, line_no, rule).
    """
    flags = lines.withColumn("s", T.strip(F.coalesce("line", F.lit("")))).join(boundaries.select("doc_id", "line_no", "rule"), ["doc_id", "line_no"], "left")
    content = F.when((F.col("s") != "") & F.col("rule").isNull(), F.struct("line_no", "s"))
    before = F.last(content, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(content, ignorenulls=True).over(in_order().rowsBetween(1, Window.unboundedFollowing))
    pages = flags.withColumn("_b", before).withColumn("_a", after).where("rule = 'page_number' and _b is not null and _a is not null")
    own, opens = T.folded_words(F.col("_b.s")), T.folded_words(F.col("_a.s"))
    short = (F.size("_own") >= 1) & (F.size("_own") <= CATCH_WORDS) & (F.length("_b.s") <= CATCH_LEN)
    prefix = F.array_join("_own", " ") == F.array_join(F.slice("_opens", F.lit(1), F.size("_own")), " ")
    pages = pages.withColumn("_own", own).withColumn("_opens", opens).withColumn("hit", short & prefix)
    per = Window.partitionBy("doc_id")
    hits, all_ = F.sum(F.col("hit").cast("int")).over(per), F.count(F.lit(1)).over(per)
    return pages.select("doc_id", F.col("_b.line_no").alias("line_no"), F.col("_b.s").alias("s"), F.col("_a.s").alias("opens"), (F.col("hit") & (hits >= CATCH_PAGES) & (hits >= CATCH_RATE * all_)).alias("accepted"))


def _cluster(texts: list[str]) -> list[int]:
    """Single linkage of like texts: the number of each one's cluster."""
    home = list(range(len(texts)))

    def top(i: int) -> int:
        while home[i] != i:
            i = home[i]
        return i

    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        if t in first:
            home[i] = first[t]
            continue
        first[t] = i
        for u, j in first.items():
            if j != i and alike(u, t, ALIKE_LINES):
                a, b = top(i), top(j)
                home[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))]


@F.pandas_udf(Y.ArrayType(Y.IntegerType()))
def _clusters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _cluster(list(t)))


def page_edges(extractions: DataFrame, key: str = "extr_id", lines: str = "text_lines", starts: str = "page_starts") -> DataFrame:
    """(doc_id, page, edge, line_no, s): the first and the last line with text of each stated page, of documents with at least three pages."""
    paged = extractions.where(F.size(starts) >= EDGE_LEAST).select(F.col(key).alias("doc_id"), F.col(starts).alias("_s"), F.posexplode(lines).alias("_p", "line")).dropDuplicates(["doc_id", "_p"])
    page = F.size(F.filter("_s", lambda x: x <= F.col("_p")))
    full = paged.withColumn("s", T.strip(F.coalesce("line", F.lit("")))).where("s <> ''").withColumn("page", page).where("page >= 1")
    per = full.groupBy("doc_id", "page").agg(F.min(F.struct("_p", "s")).alias("head"), F.max(F.struct("_p", "s")).alias("foot"))
    both = per.select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(e).alias("edge"), F.col(e).alias("x")) for e in ("head", "foot")])).alias("e"))
    return both.select("doc_id", "page", "e.edge", (F.col("e.x._p") + 1).alias("line_no"), "e.x.s")


def edges(extractions: DataFrame, key: str = "extr_id", lines: str = "text_lines", starts: str = "page_starts") -> DataFrame:
    """(doc_id, line_no, edge, s, cluster_size): first and last lines of stated pages that recur on at
    least three pages, heads and feet apart, damage allowed for.  Fewer than three pages: nothing.
    """
    both = page_edges(extractions, key, lines, starts).withColumn("key", F.when(T.page_number(F.col("s")).isNotNull(), F.lit("#")).otherwise(T.line_key(F.col("s"))))
    rows = both.where("key <> ''").groupBy("doc_id", "edge").agg(F.array_sort(F.collect_list(F.struct("line_no", "s", "key"))).alias("_r"))
    rows = rows.withColumn("_c", _clusters(F.transform("_r", lambda x: x["key"])))
    flat = rows.select("doc_id", "edge", F.explode(F.arrays_zip("_r", "_c")).alias("z")).select("doc_id", "edge", "z._r.line_no", "z._r.s", F.col("z._c").alias("c"))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "edge", "c"))
    return flat.withColumn("cluster_size", size.cast("int")).where(F.col("cluster_size") >= EDGE_LEAST).select("doc_id", "line_no", "edge", "s", "cluster_size")


PREFIX = r"^\s*((?:\d{1,4}\s+)?(?:[\p{Lu}][\p{Lu}\p{Nd}'’\"“”-]*[ .,]{1,2}){1,11})"


def page_shape(lines: DataFrame) -> DataFrame:
    """(doc_id, text_lines, median_length, cv, page_per_line): whether every line is a page: at least 20 lines, long and even in length."""
    full = lines.withColumn("_n", F.length(T.strip(F.coalesce("line", F.lit(""))))).where("_n > 0")
    per = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("text_lines"), F.median("_n").alias("median_length"), F.round(F.stddev_pop("_n") / F.avg("_n"), 6).alias("cv"))
    return per.withColumn("page_per_line", F.expr("text_lines >= 20 and median_length >= 200 and cv < 0.75"))


def page_per_line(lines: DataFrame) -> DataFrame:
    """(doc_id) of documents whose every line is a page."""
    return page_shape(lines).where("page_per_line").select("doc_id")


def prefix_heads(lines: DataFrame, gate: bool = True) -> DataFrame:
    """(doc_id, line_no, prefix, end): capitalised heads run into the text of their page, that recur
    on at least three pages; ``end`` is where the text goes on (count of characters to drop).
    """
    pages = lines.join(page_per_line(lines), "doc_id", "left_semi") if gate else lines
    got = pages.withColumn("prefix", F.regexp_extract("line", PREFIX, 1)).where("prefix <> ''").withColumn("key", T.line_key(F.col("prefix"))).where("key <> ''")
    groups = got.groupBy("doc_id", "key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("line_no").alias("first_line"))
    rows = groups.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_line", "key", "n"))).alias("_r"))
    home = rows.withColumn("_h", _merged_prefixes(F.transform("_r", lambda x: x["key"]), F.transform("_r", lambda x: x["n"])))
    flat = home.select("doc_id", "_r", F.posexplode("_h").alias("i", "h")).select("doc_id", F.element_at("_r", F.col("i") + 1)["key"].alias("key"), F.element_at("_r", F.col("h") + 1)["key"].alias("series"), F.element_at("_r", F.col("i") + 1)["n"].alias("n"))
    sizes = flat.groupBy("doc_id", "series").agg(F.sum("n").alias("size"))
    taken = flat.join(sizes.where(F.col("size") >= PREFIX_LEAST), ["doc_id", "series"]).select("doc_id", "key", "series")
    return got.join(taken, ["doc_id", "key"]).select("doc_id", "line_no", "series", "prefix", F.length(F.regexp_extract("line", PREFIX, 0)).alias("end"))


def head_chapters(heads: DataFrame) -> DataFrame:
    """(doc_id, series, first_line, last_line): series of heads that follow one another like chapters.

    ``heads``: (doc_id, series, line_no).  While spans overlap, the one that overlaps most others is
    dropped (the title on every page); more than three series must be there, three must be left.
    """
    spans = heads.groupBy("doc_id", "series").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    rows = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "last_line", "series"))).alias("_r")).where(F.size("_r") > 3)

    def settle(batch: pd.Series) -> pd.Series:
        out = []
        for spans_ in batch:
            left = [(int(x["first_line"]), int(x["last_line"]), i) for i, x in enumerate(spans_)]
            while True:
                clash = {i: sum(a <= d and c <= b for c, d, j in left if j != i) for a, b, i in left}
                if not clash or max(clash.values()) == 0:
                    break
                worst = max(left, key=lambda x: (clash[x[2]], x[1] - x[0], -x[2]))
                left.remove(worst)
            out.append([i for _, _, i in left] if len(left) >= 3 else [])
        return pd.Series(out)

    keep = F.pandas_udf(settle, Y.ArrayType(Y.IntegerType()))
    return rows.withColumn("_k", keep("_r")).select("doc_id", F.explode(F.transform("_k", lambda i: F.element_at("_r", i + 1))).alias("x")).select("doc_id", "x.series", "x.first_line", "x.last_line")


def strip_prefixes(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines with the heads that :func:`prefix_heads` found in front of them taken off."""
    got = lines.join(heads.groupBy("doc_id", "line_no").agg(F.max("end").alias("_end")), ["doc_id", "line_no"], "left")
    bare = F.when(F.col("_end").isNull(), F.col("line")).otherwise(F.expr("substring(line, _end + 1)"))
    return got.withColumn("line", bare).drop("_end")
