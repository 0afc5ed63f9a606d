"""The queries and their SQL over a small fixture that holds what the test tables lack: notices, marks around
an e-book's text, headings on two lines, notes that run on, spaced verse, answered reviews.
"""

import datetime as dt
import os

import duckdb
import pytest

from lectern.plans import queries as core

LICENCE = "This eBook is for the use of anyone anywhere. You may copy it, give it away or re-use it under the terms of the Project Gutenberg License at www.gutenberg.org, a trademark of the Project Gutenberg Literary Archive Foundation."
FILES = {
    1: ["*** START OF THE PROJECT GUTENBERG EBOOK ***", "", "Produced by A. B. and friends", "", "CONTENTS", "", "CHAPTER", "", "I.", "", "The lan-", "tern and the remark-", "able lantern[1] stood by[2] and by[1].", "", "[1] The first half of the note", "and its second half.", "[2] Another.", "", "[3]", "{4} brace note", "", "CHAPTER", "XIV", "", "Text of the mid-", "night hour. See [9].", "", "*** END OF THIS PROJECT GUTENBERG EBOOK ***"],
    2: [LICENCE, "", "The book pages were scanned and converted to EPUB", "", "the text on this page is estimated to be only 12.5% accurate", "", "Transcriber's Note:", "", "PREFACE", "", "1. Introduction", "2.1 Method of work", "IV", "12."],
    3: [x for k in range(14) for x in (f"  O lift the lamp number {k},", "")] + ["", "", ""] + [x for k in range(6) for x in ("and walk along the road to the mill with me", "")],
    4: [x for k in range(8) for x in ("THE SILENT TOWER", "", *[f"body line {k} {j} goes on and on" for j in range(9)], str(k + 1))],
    5: ["", "  ", ""],
    6: [None, "ſo the ſong goes", "Ὀδυσσεύς, ἡ ΣΟΦΙΑ"],
}
TEXTS = {1: "@ann · 3 h\nWhat a long comment about the mill\nReply\n12 likes\n" * 6, 2: "a\r\nb\rc", 3: "", 4: None, 5: "x\n\n\n\n\ny\n \n\n"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    now = dt.datetime(2025, 1, 1)
    lines = [(f, n, x, now) for f, ls in FILES.items() for n, x in enumerate(ls, 1)]
    tables = {
        "doc_lines": (lines + lines[:5], "file_id long, line_no int, line string, loaded_at timestamp"),
        "documents": ([(k, "h: 1\r\n" if k % 2 else None, None if k == 3 else ("﻿" * (k == 5) + (t or "é\r\n")).encode("utf-8" if k != 2 else "cp1252"), t, "en" if k % 2 else None) for k, t in TEXTS.items()], "doc_id long, headers string, raw_bytes binary, text string, lang string"),
        "extractions": ([(1, "ocr", ["HEAD", "a bro-", "ken line", "1", "HEAD", "", "text", "2", "HEAD", "more", "3"], [0, 4, 8], None, now), (2, "image", None, None, "scan by Tesseract", now), (3, "text", ["​"], [0], "x", now)], "extr_id long, kind string, text_lines array<string>, page_starts array<int>, note string, extracted_at timestamp"),
        "breaks": ([(1, 1, 2, "bro-ken", "join"), (2, 1, 7, "x-y", "keep"), (3, 2, 1, None, "join")], "brk_id long, extr_id long, line_no int, hyphenated string, decision string"),
        "common_words": ([("en", "hour"), ("en", "midnight"), (None, None)], "lang string, word string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in tables:
        con.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    return d, con


def plain(x):
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


ROWS = {"notice_lines": 5, "notice_blocks": 3, "split_headings": 2, "footnote_bodies": 3, "double_spaced": 1, "interface_label_counts": 2}


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    d, con = small
    got = core.queries()[name](spark, d)
    cols = sorted(got.columns)
    ours = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=str)
    found = con.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert ours == sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()], key=str)
    assert len(ours) >= ROWS.get(name, 0)
    assert os.path.isdir(d)
