"""The library's front door: load, analyse, render and write whole folders of documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import furniture, hyphens, interface, metrics, notes, regions, render, report, review, verse
from .operators import lines as L
from .session import cut
from .sources import readers


@dataclass
class Analysis:
    """What was found in a set of documents; every part is a DataFrame, computed when asked for.

    ``docs``: doc_id, text (null texts have no lines), and page_starts (0-based first lines of pages) if known.
    ``decisions``: answers of a review (kind, key, decision).  Headers and licences are left out of all rules
    but segmentation; page furniture is looked for in the body alone.
    """

    docs: DataFrame
    decisions: DataFrame | None = None

    @cached_property
    def lines(self) -> DataFrame:
        return cut(L.explode_lines(self.docs))

    @cached_property
    def regions(self) -> DataFrame:
        return cut(regions.segment(self.lines))

    @cached_property
    def work(self) -> DataFrame:
        """The lines with headers and licences blank."""
        return cut(regions.masked(self.lines, self.regions))

    @cached_property
    def paged(self) -> DataFrame | None:
        """(doc_id, text_lines, page_starts) of documents with stated pages."""
        if "page_starts" not in self.docs.columns:
            return None
        unix = F.regexp_replace("text", r"\r\n?", "\n")
        return self.docs.where("page_starts is not null").select("doc_id", F.split(unix, "\n").alias("text_lines"), "page_starts")

    @cached_property
    def furniture(self) -> DataFrame:
        body = self.regions.where("label = 'body'").select("doc_id", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
        return cut(furniture.in_documents(self.lines, cut(body), self.paged))

    @cached_property
    def prefixes(self) -> DataFrame:
        """Heads run into the text of pages that are one line each."""
        return cut(furniture.prefix_heads(self.lines))

    @cached_property
    def protected(self) -> DataFrame:
        return cut(verse.protected_spans(self.work))

    @cached_property
    def breaks(self) -> DataFrame:
        got = hyphens.decisions(self.work)
        return cut(got if self.decisions is None else review.apply(got, self.decisions))

    @cached_property
    def interface(self) -> DataFrame:
        return cut(interface.labels(self.work))

    @cached_property
    def notes(self) -> DataFrame:
        return cut(notes.bodies(self.work))

    @cached_property
    def note_pairs(self) -> DataFrame:
        return cut(notes.pairs(self.work))

    def facts(self, variants: list[render.Variant]) -> render.Facts:
        """What rendering ``variants`` needs to know; what none asks for isn't looked for."""
        away = any(v.footnotes != "retain" for v in variants)
        return render.Facts(
            furniture=self.furniture if any(v.drop_furniture for v in variants) else None, interface=self.interface if any(v.drop_interface for v in variants) else None,
            notes=self.notes if away else None, note_pairs=self.note_pairs if away else None, decisions=self.decisions,
        )

    def render(self, variants: list[render.Variant]) -> DataFrame:
        """(doc_id, variant, text)."""
        return render.render_variants(self.lines, self.regions, variants, self.facts(variants))

    def removals(self, variants: list[render.Variant]) -> DataFrame:
        """What each variant takes out of each document, in counts."""
        return render.removals(self.lines, self.regions, variants, self.facts(variants))

    def review_queue(self) -> DataFrame:
        queue = review.items(self.breaks, self.note_pairs)
        return queue if self.decisions is None else review.carry(queue, self.decisions)

    def inspect(self) -> DataFrame:
        """(doc_id, label, regions, line_count, words)."""
        return regions.label_totals(self.lines, self.regions)

    def uncovered(self) -> DataFrame:
        return regions.gaps(self.lines, self.regions)

    def findings(self) -> DataFrame:
        """(doc_id, rule, findings): how often each rule fired in each document."""
        count = lambda df, rule: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings")).select("doc_id", F.lit(rule).alias("rule"), "findings")
        parts = [
            self.furniture.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("findings")).select("doc_id", "rule", "findings"), count(self.prefixes, "prefix_head"), count(self.breaks, "broken_word"),
            count(self.breaks.where("decision not in ('join', 'keep')"), "undecided_break"), count(self.interface, "interface"), count(self.note_pairs.where("paired"), "note"), count(self.note_pairs.where("not paired"), "unpaired_note"), count(self.protected, "protected_passage"),
        ]
        return reduce(DataFrame.unionByName, parts)


class CorpusSession:
    """Reading of documents, and their analysis, on a Spark session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def read(self, path: str, pattern: str = "*", strict: bool = False) -> DataFrame:
        """Documents of a folder: doc_id (of the path), name, text and what the importer saw."""
        return readers.read_folder(self.spark, path, pattern, strict).withColumn("doc_id", F.xxhash64("name"))

    def analyse(self, docs: DataFrame, decisions: str | DataFrame | None = None) -> Analysis:
        if isinstance(decisions, str):
            decisions = review.read(self.spark, decisions)
        return Analysis(docs.select("doc_id", "text", *(["page_starts"] if "page_starts" in docs.columns else [])), decisions)

    def variant(self, name: str, keep: list[str], **options: object) -> render.Variant:
        """A variant of one's own: the labels it keeps, and any of the options of :class:`render.Variant`."""
        return render.custom(name, keep, **options)

    def prepare(self, docs: DataFrame, out: str, variants: list[str | render.Variant] | None = None, decisions: str | None = None, options: dict | None = None) -> Analysis:
        """Write variants (partitioned), logs (rows, and a file per document), removed notes and the review queue below ``out``."""
        from dataclasses import replace

        a = self.analyse(docs, decisions)
        chosen = [v for x in (variants or render.DEFAULT) for v in ([x] if isinstance(x, render.Variant) else render.resolve([x]))]
        chosen = [replace(v, **(options or {})) if v.name != "verbatim" else v for v in chosen]
        text = cut(a.render(chosen))
        text.write.mode("overwrite").partitionBy("variant").parquet(f"{out}/text")
        measured = cut(render.deltas(render.stats(text)))
        removed = render.dropped(a.regions, chosen)
        ids = docs.where("text is not null").select("doc_id", *[c for c in report.SOURCE if c in docs.columns])
        found, counts = cut(a.findings()), cut(a.removals(chosen))
        rows = report.json_log(ids, a.regions, measured, removed, found, counts)
        pages = report.markdown_log(ids, a.regions, measured, removed, a.uncovered(), found, counts, chosen)
        rows.write.mode("overwrite").parquet(f"{out}/log_json")
        pages.write.mode("overwrite").parquet(f"{out}/log_markdown")
        report.write_files(rows, f"{out}/logs", "json")
        report.write_files(pages, f"{out}/logs", "md")
        metrics.verdicts(measured, a.uncovered()).write.mode("overwrite").parquet(f"{out}/verdicts")
        regions.integration(a.lines, a.regions, measured).write.mode("overwrite").parquet(f"{out}/overview")
        render.extracted_notes(a.notes, a.note_pairs).write.mode("overwrite").parquet(f"{out}/notes")
        review.write(a.review_queue(), f"{out}/review")
        return a


def register_sql(spark: SparkSession) -> None:
    """SQL functions for use in queries: html_text, markdown_text, detect_newline and a table function explode_lines."""
    from pyspark.sql.functions import pandas_udf, udtf
    from pyspark.sql.types import StringType

    spark.udf.register("html_text", pandas_udf(lambda s: s.map(lambda x: None if x is None else readers.html_text(x)), StringType(), functionType=200))
    spark.udf.register("markdown_text", pandas_udf(lambda s: s.map(lambda x: None if x is None else readers.markdown_text(x)), StringType(), functionType=200))

    @udtf(returnType="line_no int, line string")
    class ExplodeLines:
        def eval(self, text: str):
            if text is not None:
                for i, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
                    yield i, line

    spark.udtf.register("explode_lines", ExplodeLines)
