"""Variants: which regions and lines a cleaned text keeps, and the text itself.

Stage order is part of the meaning: regions, furniture and interface, broken words, reflow, blanks.
Later stages look at the output of earlier ones, never at the source again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions import text as T
from ..session import cut
from . import furniture, hyphens, verse
from .lines import spread
from .regions import LABELS

STAGES = ("regions", "furniture", "dehyphenate", "reflow", "whitespace")


@dataclass(frozen=True)
class Variant:
    """A named choice of what to keep and of what to repair."""

    name: str
    drop: tuple[str, ...] = ("header", "licence")
    description: str = ""
    strip_trailing_space: bool = True
    collapse_blank_lines: bool = True
    max_blank_lines: int = 1
    collapse_inner_space: bool = False
    drop_headings: bool = False
    drop_furniture: bool = False
    drop_interface: bool = False
    footnotes: str = "retain"  # retain, remove, extract
    dehyphenate: bool = False
    reflow: bool = False

    def keeps(self, label: str) -> bool:
        return label not in self.drop


BUILTIN = {
    v.name: v
    for v in (
        Variant("verbatim", (), "everything, line ends normalised: the baseline", collapse_blank_lines=False),
        Variant("full", ("header", "licence"), "all but apparatus"),
        Variant("body-and-front", ("header", "licence", "back_matter"), "front matter and body"),
        Variant("body-only", ("header", "licence", "front_matter", "back_matter"), "the work itself"),
        Variant("body-no-headings", ("header", "licence", "front_matter", "back_matter"), "the work without division headings", drop_headings=True),
    )
}
DEFAULT = ("verbatim", "full", "body-only", "body-no-headings")


def custom(name: str, keep: list[str], **options: object) -> Variant:
    """A variant that keeps just the listed labels."""
    wrong = sorted(set(keep) - set(LABELS))
    if wrong:
        raise ValueError(f"no such label: {', '.join(wrong)}; labels are {', '.join(LABELS)}")
    return replace(Variant(name, tuple(x for x in LABELS if x not in keep)), **options)


@dataclass
class Facts:
    """What detectors found; each part may be missing."""

    furniture: DataFrame | None = None
    interface: DataFrame | None = None
    notes: DataFrame | None = None
    note_pairs: DataFrame | None = None
    decisions: DataFrame | None = None


def kept_all(lines: DataFrame, regions: DataFrame, variants: list[Variant], facts: Facts | None = None) -> DataFrame:
    """(doc_id, variant, line_no, region_idx, label, line): the lines each variant keeps, before any repair.

    One join of lines and regions serves all variants: a line is then dealt to those that keep it.
    """
    facts = facts or Facts()
    owned = spread(regions, "region_idx", "label")
    got = lines.join(owned, ["doc_id", "line_no"]).select("doc_id", "line_no", "region_idx", "label", F.coalesce("line", F.lit("")).alias("line"))
    flag = lambda df, name: df.select("doc_id", "line_no").distinct().withColumn(name, F.lit(True)).hint("merge")
    for name, found in (("_furniture", facts.furniture), ("_interface", facts.interface)):
        got = got.withColumn(name, F.lit(None).cast("boolean")) if found is None else got.join(flag(found, name), ["doc_id", "line_no"], "left")
    stripped = F.col("line")
    if facts.notes is not None and facts.note_pairs is not None:
        sure = facts.note_pairs.where("paired").select("doc_id", F.col("body_line").alias("first_line")).hint("merge")
        inside = spread(facts.notes.join(sure, ["doc_id", "first_line"], "left_semi"))
        labels = facts.note_pairs.where("paired").groupBy("doc_id").agg(F.collect_set("label").alias("_labels")).hint("merge")
        got = got.join(flag(inside, "_note"), ["doc_id", "line_no"], "left").join(labels, "doc_id", "left")
        stripped = F.when(F.col("_labels").isNotNull(), T.strip_notes(F.col("line"), F.col("_labels"))).otherwise(F.col("line"))
    else:
        got = got.withColumn("_note", F.lit(None).cast("boolean"))
    heading = H.is_division(F.col("line")) if any(v.drop_headings for v in variants) else F.lit(False)
    parts = []
    for v in variants:
        away = v.footnotes in ("remove", "extract")
        keep = ~F.col("label").isin(*v.drop) if v.drop else F.lit(True)
        for asked, name in ((v.drop_furniture, "_furniture"), (v.drop_interface, "_interface"), (away, "_note")):
            keep = keep & F.col(name).isNull() if asked else keep
        keep = keep & ~((F.col("label") == "body") & F.col("_heading")) if v.drop_headings else keep
        text = F.col("_stripped") if away else F.col("line")
        text = F.regexp_replace(text, "[ \t]+$", "") if v.strip_trailing_space else text
        text = F.regexp_replace(text, "(?<=\\S)[ \t]+(?=\\S)", " ") if v.collapse_inner_space else text
        parts.append(F.when(keep, F.struct(F.lit(v.name).alias("variant"), text.alias("line"))))
    dealt = got.withColumns({"_stripped": stripped, "_heading": heading}).select("doc_id", "line_no", "region_idx", "label", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("v"))
    return dealt.select("doc_id", "v.variant", "line_no", "region_idx", "label", "v.line")


def kept_lines(lines: DataFrame, regions: DataFrame, variant: Variant, facts: Facts | None = None) -> DataFrame:
    """:func:`kept_all` of one variant: (doc_id, line_no, region_idx, label, line)."""
    return kept_all(lines, regions, [variant], facts).drop("variant")


def _assembled(kept: DataFrame) -> DataFrame:
    """Kept lines with a blank line between regions, renumbered: (doc_id, line_no, line)."""
    parts = kept.select("doc_id", "region_idx", F.lit(1).alias("_o"), "line_no", "line")
    seps = kept.select("doc_id", "region_idx").distinct().select("doc_id", "region_idx", F.lit(0).alias("_o"), F.lit(0).alias("line_no"), F.lit("").alias("line"))
    order = Window.partitionBy("doc_id").orderBy("region_idx", "_o", "line_no")
    return parts.unionByName(seps).select("doc_id", F.row_number().over(order).alias("line_no"), "line")


def tidy(text: Column, variant: Variant) -> Column:
    """Blank lines as the variant wants them; one line end at the end."""
    if variant.collapse_blank_lines:
        text = F.regexp_replace(text, "\n(?:[ \t]*\n){%d,}" % (variant.max_blank_lines + 1), "\n" * (variant.max_blank_lines + 1))
    return F.concat(F.regexp_replace(text, r"^\s*\n|\s+$", ""), F.lit("\n"))


def _every(lines: DataFrame, text: DataFrame, variants: list[Variant]) -> DataFrame:
    """A row for each document and variant; empty where nothing is kept."""
    all_ = lines.select("doc_id").distinct().withColumn("variant", F.explode(F.array(*[F.lit(v.name) for v in variants])))
    return all_.join(text, ["doc_id", "variant"], "left").select("doc_id", "variant", F.coalesce("text", F.lit("")).alias("text"))


def _plain(lines: DataFrame, regions: DataFrame, variants: list[Variant], facts: Facts | None) -> DataFrame:
    """Variants without repairs, all in one pass: lines by region, a blank line between regions."""
    kept = kept_all(lines, regions, variants, facts)
    parts = kept.groupBy("doc_id", "variant").agg(F.array_sort(F.collect_list(F.struct("region_idx", "line_no", "line"))).alias("_l"))
    # a line that opens a region has a blank one before it
    joined = F.transform("_l", lambda x, i: F.when((i > 0) & (x["region_idx"] != F.coalesce(F.try_element_at("_l", F.when(i > 0, i)), F.element_at("_l", 1))["region_idx"]), F.concat(F.lit("\n"), x["line"])).otherwise(x["line"]))
    parts = parts.select("doc_id", "variant", F.array_join(joined, "\n").alias("_t"))
    body = F.coalesce(*[F.when(F.col("variant") == v.name, tidy(F.col("_t"), v)) for v in variants])
    return _every(lines, parts.select("doc_id", "variant", body.alias("text")), variants)


def render(lines: DataFrame, regions: DataFrame, variant: Variant, facts: Facts | None = None) -> DataFrame:
    """(doc_id, variant, text): the cleaned text of each document; empty where nothing is kept."""
    heads = variant.drop_furniture
    if not (variant.dehyphenate or variant.reflow or heads):
        return _plain(lines, regions, [variant], facts)
    out = cut(_assembled(kept_lines(lines, regions, variant, facts)))  # the next stages look at it several times
    if heads:
        # heads run into the text are looked for in what is written, before line ends go
        out = furniture.strip_prefixes(out, furniture.prefix_heads(out))
        out = cut(out) if variant.dehyphenate or variant.reflow else out
    if variant.dehyphenate:
        decided = hyphens.decisions(out)
        if facts is not None and facts.decisions is not None:
            from .review import apply

            decided = apply(decided, facts.decisions)
        out = hyphens.join_lines(out, decided)
        out = cut(out) if variant.reflow else out
    if variant.reflow:
        blocks = verse.reflow(out)
        text = blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_line", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    else:
        text = out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return _every(lines, text.select("doc_id", F.lit(variant.name).alias("variant"), tidy(F.col("text"), variant).alias("text")), [variant])


def resolve(names: list[str] | None = None) -> list[Variant]:
    """Variants by name; an unknown name is an error, not a gap."""
    names = list(names or DEFAULT)
    wrong = [n for n in names if n not in BUILTIN]
    if wrong:
        raise ValueError(f"no such variant: {', '.join(wrong)}; there are {', '.join(BUILTIN)}")
    return [BUILTIN[n] for n in names]


def render_all(lines: DataFrame, regions: DataFrame, names: list[str] | None = None, facts: Facts | None = None) -> DataFrame:
    return render_variants(lines, regions, resolve(names), facts)


def render_variants(lines: DataFrame, regions: DataFrame, variants: list[Variant], facts: Facts | None = None) -> DataFrame:
    """(doc_id, variant, text) of all variants: those without repairs in one pass, the others one by one."""
    plain = [v for v in variants if not (v.dehyphenate or v.reflow or v.drop_furniture)]
    out = _plain(lines, regions, plain, facts) if plain else None
    for v in variants:
        if v not in plain:
            got = render(lines, regions, v, facts)
            out = got if out is None else out.unionByName(got)
    return out


def removals(lines: DataFrame, regions: DataFrame, variants: list[Variant], facts: Facts | None = None) -> DataFrame:
    """(doc_id, variant, regions_kept, regions_dropped, lines_kept, furniture_removed, interface_removed, footnotes_removed, footnote_lines_removed)."""
    facts = facts or Facts()
    base = regions.withColumn("v", F.explode(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.array(*[F.lit(x) for x in v.drop]).cast("array<string>").alias("drop")) for v in variants]))).withColumn("_k", ~F.array_contains("v.drop", F.col("label")))
    got = base.groupBy("doc_id", "v.variant").agg(F.sum(F.col("_k").cast("int")).alias("regions_kept"), F.sum((~F.col("_k")).cast("int")).alias("regions_dropped"))
    inside = spread(base.where("_k"), "v.variant")
    took = {"furniture_removed": (facts.furniture, [v.name for v in variants if v.drop_furniture]), "interface_removed": (facts.interface, [v.name for v in variants if v.drop_interface])}
    away = [v.name for v in variants if v.footnotes in ("remove", "extract")]
    if facts.notes is not None and facts.note_pairs is not None:
        sure = facts.note_pairs.where("paired").hint("merge")
        held = facts.notes.join(sure.select("doc_id", F.col("body_line").alias("first_line")), ["doc_id", "first_line"], "left_semi")
        took["footnote_lines_removed"] = (spread(held), away)
        got = got.join(sure.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_p")), "doc_id", "left").withColumn("footnotes_removed", F.when(F.col("variant").isin(*away), F.coalesce("_p", F.lit(0))).otherwise(F.lit(0)) if away else F.lit(0)).drop("_p")
    else:
        got = got.withColumn("footnotes_removed", F.lit(0))
        took["footnote_lines_removed"] = (None, away)
    kept = kept_all(lines, regions, variants, facts).groupBy("doc_id", "variant").agg(F.count(F.lit(1)).alias("lines_kept"))
    got = got.join(kept.hint("merge"), ["doc_id", "variant"], "left")
    for name, (found, asked) in took.items():
        if found is None or not asked:
            got = got.withColumn(name, F.lit(0))
            continue
        n = inside.where(F.col("variant").isin(*asked)).join(found.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"]).groupBy("doc_id", "variant").agg(F.count(F.lit(1)).alias(name))
        got = got.join(n.hint("merge"), ["doc_id", "variant"], "left")
    return got.na.fill(0)


def stats(rendered: DataFrame) -> DataFrame:
    """(doc_id, variant, characters, line_count, word_tokens, word_types)."""
    t = F.col("text")
    w = T.words(t)
    return rendered.select("doc_id", "variant", F.length(t).alias("characters"), F.regexp_count(t, F.lit("\n")).alias("line_count"), F.size(w).alias("word_tokens"), F.size(F.array_distinct(F.transform(w, F.lower))).alias("word_types"))


def deltas(measured: DataFrame) -> DataFrame:
    """Adds the difference of tokens and types to the verbatim variant of the same document, and the share lost."""
    per = Window.partitionBy("doc_id")
    base = lambda c: F.max(F.when(F.col("variant") == "verbatim", F.col(c))).over(per)
    got = measured.withColumns({"base_tokens": base("word_tokens"), "base_types": base("word_types")})
    lost = F.when(F.col("base_tokens") > 0, F.round(100.0 * (F.col("word_tokens") - F.col("base_tokens")) / F.col("base_tokens"), 2))
    return got.withColumns({"token_delta": F.col("word_tokens") - F.col("base_tokens"), "type_delta": F.col("word_types") - F.col("base_types"), "token_percent": lost})


def dropped(regions: DataFrame, variants: list[Variant]) -> DataFrame:
    """(doc_id, variant, region_idx, label, kind, first_line, last_line, evidence): what each variant leaves out, and why."""
    keep = F.array(*[F.struct(F.lit(v.name).alias("variant"), F.array(*[F.lit(x) for x in v.drop]).cast("array<string>").alias("drop")) for v in variants])
    got = regions.withColumn("v", F.explode(keep)).where(F.array_contains("v.drop", F.col("label")))
    return got.select("doc_id", "v.variant", "region_idx", "label", "kind", "first_line", "last_line", "evidence")


def marked(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """Source lines with ``is_dropped``, for reading side by side."""
    here = kept.select("doc_id", "line_no").distinct().withColumn("_k", F.lit(True))
    return lines.join(here, ["doc_id", "line_no"], "left").select("doc_id", "line_no", "line", F.col("_k").isNull().alias("is_dropped"))


def extracted_notes(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, first_line, text): the parallel text of paired notes, "[label]<tab>text"."""
    sure = pairs.where("paired").select("doc_id", F.col("body_line").alias("first_line"))
    return notes.join(sure, ["doc_id", "first_line"], "left_semi").select("doc_id", "first_line", F.concat(F.lit("["), "label", F.lit("]\t"), "text").alias("text"))
