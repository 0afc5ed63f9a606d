"""Logs of what was found and removed: JSON rows for machines, Markdown for readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import Variant

#: what the importer saw of a document, as far as it is known
SOURCE = ("name", "encoding", "had_bom", "encoding_confidence", "newline", "source_bytes", "replacement_chars", "container", "error")
#: what a rule that found nothing says about the text
SILENT = {
    "running_head": "No page furniture: no page numbers rise at even distances, so no line can recur once a page.",
    "broken_word": "No broken words: no line ends in a hyphen that a word goes on from.",
    "interface": "No interface labels: there are no records of handles and times.",
    "note": "No notes: nothing in brackets opens a line and is marked elsewhere.",
    "protected_passage": "No protected passages: line ends don't follow phrases often enough, or lines aren't wrapped.",
}


def _per(df: DataFrame, name: str, *cols: str | Column) -> DataFrame:
    return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def json_log(docs: DataFrame, regions: DataFrame, measured: DataFrame, dropped: DataFrame, findings: DataFrame | None = None, removals: DataFrame | None = None) -> DataFrame:
    """(doc_id, log): one JSON document per input: what the importer saw, regions (levels and parents included),
    findings of the rules, variants with what they took out, and removed regions.
    """
    source = [c for c in SOURCE if c in docs.columns]
    got = docs.select("doc_id", *([F.struct(*source).alias("source")] if source else []))
    parts = [
        _per(regions, "regions", "region_idx", "label", "kind", "title", "first_line", "last_line", F.round("confidence", 2).alias("confidence"), "evidence", "level", "parent"),
        _per(measured, "variants", "variant", "characters", "line_count", "word_tokens", "word_types", "token_delta", "type_delta", "token_percent"),
        _per(dropped, "removed", "variant", "region_idx", "label", "kind", "first_line", "last_line", "evidence"),
    ]
    if findings is not None:
        parts.append(_per(findings, "findings", "rule", "findings"))
    if removals is not None:
        parts.append(_per(removals, "counts", "variant", *[c for c in removals.columns if c not in ("doc_id", "variant")]))
    for part in parts:
        got = got.join(part.hint("merge"), "doc_id", "left")  # packed tables look small enough to broadcast
    return got.select("doc_id", F.to_json(F.struct(*got.columns)).alias("log"))


def region_rows(regions: DataFrame) -> DataFrame:
    """(doc_id, region_idx, row): the segmentation as rows of a Markdown table."""
    row = F.format_string("| %d-%d | %s | %s | %s | %.2f | %s |", "first_line", "last_line", "label", "kind", F.regexp_replace("title", r"\|", "/"), "confidence", "evidence")
    return regions.select("doc_id", "region_idx", row.alias("row"))


def _lines(df: DataFrame, name: str, order: Column, line: Column) -> DataFrame:
    """A document's lines in one text."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("_o"), line.alias("_r"))))
    return df.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["_r"]), "\n").alias(name))


def silent(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, quiet): for documents in which no rule fired, what each of them looked for."""
    fired = findings.where("findings > 0").select("doc_id").distinct()
    return ids.select("doc_id").join(fired, "doc_id", "left_anti").withColumn("quiet", F.lit("\n".join(f"- {x}" for x in SILENT.values())))


def markdown_log(
    docs: DataFrame, regions: DataFrame, measured: DataFrame, dropped: DataFrame, uncovered: DataFrame, findings: DataFrame | None = None, removals: DataFrame | None = None, variants: list[Variant] | None = None
) -> DataFrame:
    """(doc_id, log): the same for a reader: source, regions and the verdict on cover, findings, variants, what
    each took out and why, and the command to run it again; where no rule fired, what was looked for.
    """
    got = docs
    sized = measured.where("variant = 'verbatim'").select("doc_id", F.format_string("- characters: %d\n- lines: %d\n- words: %d, different ones: %d", "characters", "line_count", "word_tokens", "word_types").alias("size"))
    parts = [
        sized,
        _lines(region_rows(regions), "r", F.col("region_idx"), F.col("row")),
        _lines(regions.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")), "labels", F.col("label"), F.format_string("%d %s", "n", "label")),
        _lines(measured, "v", F.col("variant"), F.format_string("| %s | %d | %d | %d | %+d | %+d |", "variant", "characters", "word_tokens", "word_types", F.coalesce("token_delta", F.lit(0)), F.coalesce("type_delta", F.lit(0)))),
        _lines(dropped, "d", F.struct("variant", "region_idx"), F.format_string("- %s: lines %d-%d (%s): %s", "variant", "first_line", "last_line", "label", "evidence")),
        uncovered.groupBy("doc_id").agg(F.sum(F.col("last_line") - F.col("first_line") + 1).alias("u")),
    ]
    if findings is not None:
        parts += [_lines(findings, "f", F.col("rule"), F.format_string("| %s | %d |", "rule", "findings")), silent(findings, docs)]
    if removals is not None:
        counts = [c for c in removals.columns if c not in ("doc_id", "variant", "regions_kept", "lines_kept")]
        told = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.format_string("%d " + c.replace("_", " "), c)) for c in counts])
        parts.append(_lines(removals.where(F.length(told) > 0), "c", F.col("variant"), F.format_string("- %s: %s", F.col("variant"), told)))
    for part in parts:
        got = got.join(part.hint("merge"), "doc_id", "left")  # packed tables look small enough to broadcast
    has = lambda c: F.col(c) if c in got.columns else F.lit(None).cast("string")
    cover = F.when(F.coalesce("u", F.lit(0)) == 0, F.lit("Every line with text is in one region.")).otherwise(F.format_string("WARNING: %d lines are in no region.", "u"))
    origin = F.concat_ws("\n", *[F.format_string(f"- {c.replace('_', ' ')}: %s", F.col(c).cast("string")) for c in SOURCE if c in docs.columns])
    section = lambda title, body: F.when(body.isNotNull() & (F.length(body) > 0), F.concat(F.lit(f"\n## {title}\n\n"), body))
    table = lambda head, body: F.when(body.isNotNull(), F.concat(F.lit(head + "\n" + "|---" * head.count("|", 1) + "|\n"), body))
    again = "python -m lectern clean PATH --out OUT --variants " + ",".join(v.name for v in variants) if variants else None
    text = F.concat_ws(
        "\n", F.format_string("# Document %s", F.col("doc_id").cast("string")), section("Source", F.concat_ws("\n", F.nullif(origin, F.lit("")), "size")),
        section("Nothing was found; this was looked for", has("quiet")),
        section("Regions", F.concat_ws("\n", table("| lines | label | kind | title | confidence | evidence |", F.col("r")), F.concat(F.lit("\nIn all: "), F.replace("labels", F.lit("\n"), F.lit(", "))), cover)),
        section("Findings", table("| rule | times |", has("f"))), section("Variants", table("| variant | characters | words | different words | words against verbatim | different words against verbatim |", F.col("v"))),
        section("Removed", F.coalesce("d", F.lit("Nothing: no notice, licence, front or back matter was recognised, so all variants hold the same lines."))), section("Counts", has("c")),
        section("To run it again", F.lit(again)),
    )
    return got.select("doc_id", text.alias("log"))


def write_files(logs: DataFrame, path: str, ext: str) -> int:
    """One file per document in the folder ``path``, written by the tasks that hold the logs; returns how many."""
    spark = logs.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    local = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file"
    if not local:
        # a shared file system is written through Spark alone: files of lines, by document
        logs.select(F.col("log").alias("value"), F.col("doc_id")).write.mode("overwrite").partitionBy("doc_id").text(f"{path}/{ext}")
        return logs.count()
    where = folder.toUri().getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(where, exist_ok=True)
        for batch in batches:
            for doc, log in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(os.path.join(where, f"{doc}.{ext}"), "w", encoding="utf-8") as f:
                    f.write(log or "")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(batch)], pa.int64())})

    return logs.select(F.col("doc_id").cast("string"), "log").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
