"""What grows with the corpus is never broadcast: tables of spans are small files, the lines that they spread to aren't."""

import pytest

from lectern.operators import furniture
from lectern.plans import queries as core

# what may not stand under a broadcast in the plan of a query
CASES = {
    "stress_verdict": "sequence(",
    "variant_removals": "sequence(",
    "variant_tokens": "sequence(",
    "integration_table": "sequence(",
    "invented_lines": "regexp_replace(coalesce",
    "markdown_log": "collect_list",
    "region_roll_up": "BroadcastExchange",
    "variant_delta": "sequence(",
    "variant_repaired": "sequence(",
    "verbatim_fidelity": "sequence(",
    "json_log": "collect_list",
    "variant_text": "sequence(",
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    own = lambda f, n: "" if n % 9 == 0 else f"CHAPTER {n // 20 + 1}" if n % 20 == 1 else f"[{n}] Note {f * n}" if n % 20 == 15 else str(n // 20) if n % 20 == 19 else f"line {f * 7919 + n * 31} of the file[{n + 1}]"
    lines = [(f, n, own(f, n)) for f in range(1, 121) for n in range(1, 61)]
    spark.createDataFrame(lines, "file_id long, line_no int, line string").coalesce(1).write.parquet(f"{d}/doc_lines.parquet")
    return d


def broadcasts(df):
    """The parts of the plan that are broadcast, as texts."""
    rows = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(r) - len(r.lstrip(" :+-")) for r in rows]
    for i, r in enumerate(rows):
        if "BroadcastExchange" in r:
            end = next((j for j in range(i + 1, len(rows)) if depth[j] <= depth[i]), len(rows))
            yield "\n".join(rows[i:end])


@pytest.mark.parametrize("name", sorted(CASES))
def test_lines_are_not_broadcast(spark, corpus, name):
    assert [b for b in broadcasts(core.queries()[name](spark, corpus)) if CASES[name] in b] == []


def test_short_lines_are_not_broadcast(spark, corpus):
    lines = core._lines(spark, corpus)
    assert [b for b in broadcasts(furniture.find(lines)) if "FileScan" in b and "Exchange hash" not in b] == []
