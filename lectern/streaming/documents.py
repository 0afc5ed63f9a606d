"""Documents as they arrive: rules are per document, so a micro-batch is analysed like any table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import Analysis
from ..session import forget, kept


def analyse_stream(docs: DataFrame, sink: Callable[[Analysis, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``sink`` on the analysis of each micro-batch of a streaming (doc_id, text[, page_starts]) table.

    A document is one row, so no state is kept and nothing waits for late rows; a sink that
    writes by batch number is exactly-once.
    """

    def batch(df: DataFrame, number: int) -> None:
        before = kept()
        try:
            sink(Analysis(df), number)
        finally:
            forget(before)  # the tables of this batch

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
