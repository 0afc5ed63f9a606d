"""The parts of an analysis together: apparatus, stated pages, catchwords, heads in the text, notes, logs."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.api import Analysis, CorpusSession
from lectern.operators import furniture, hyphens, metrics, notes, regions, render, report, review
from lectern.session import shared_dir

LICENCE = ["*** END OF THE PROJECT GUTENBERG EBOOK ***", "", "a copy-", "right of the copyright", "[1] no note at all"]


def docs_of(spark, *texts, starts=None):
    rows = [(i, "\n".join(t) if isinstance(t, list) else t, (starts or {}).get(i)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, page_starts array<int>")


def test_rules_leave_apparatus_out(spark):
    a = Analysis(docs_of(spark, ["CHAPTER I", "", "the lan-", "tern and the lantern", "", *LICENCE]))
    assert [(r.line_no, r.joined) for r in a.breaks.collect()] == [(3, "lantern")]
    assert a.notes.count() == 0 and a.note_pairs.count() == 0
    assert regions.coverage(a.lines, a.regions).where("text_lines <> covered_once").count() == 0


def paged(head="THE OLD MILL", pages=6):
    lines, starts = ["CHAPTER I"], []
    for k in range(pages):
        starts.append(len(lines))
        lines += [head, *[f"text {k} {j} goes on and on along the road" for j in range(7)], str(40 + k)]
    return lines, starts


def test_stated_pages_are_used_and_nothing_is_inferred(spark):
    lines, starts = paged()
    found = {r.line_no: r.rule for r in Analysis(docs_of(spark, lines, starts={1: starts})).furniture.collect()}
    assert found == {s + 1: "head" for s in starts} | {s + 9: "foot" for s in starts}
    few = Analysis(docs_of(spark, lines, starts={1: starts[:2]})).furniture
    assert {r.rule for r in few.collect()} == {"running_head", "page_number"}  # two pages are no ground: inferred
    assert Analysis(docs_of(spark, lines).drop("page_starts")).furniture.count() == few.count()


def test_catchwords_are_furniture(spark):
    lines, words = ["CHAPTER I"], "winter harbour quietly seldom engine flowers market pebble lantern".split()
    for k in range(8):
        lines += [f"{words[k]} opens the page with some words", *[f"body {k} {j} goes on and on along the road" for j in range(8)], words[k + 1], str(k + 1)]
    lines += ["lantern the last of it", "and its end"]
    a = Analysis(docs_of(spark, lines))
    rules = {r.line_no: r.rule for r in a.furniture.collect()}
    assert sorted(n for n, x in rules.items() if x == "catchword") == [1 + 11 * k + 10 for k in range(8)]
    text = a.render([render.custom("bare", ["body"], drop_furniture=True)]).first().text
    assert "lantern the last" in text and "\nlantern\n" not in text


def page_lines(n=24, heads=("THE CYCLONE", "THE MUNCHKINS", "THE SCARECROW", "THE ROAD"), gap=6):
    words = "and so they went along the yellow road for a very long time until the evening came and they slept. "
    return [f"{heads[k // gap]} {k + 3} It was page {k} " + words * 3 for k in range(n)]


def test_heads_in_front_of_pages_divide_the_text_and_are_taken_off(spark):
    lines = page_lines()
    a = Analysis(docs_of(spark, lines, ["THE CYCLONE short line"] * 3))
    body = [(r.title, r.first_line, r.evidence) for r in a.regions.where("doc_id = 1 and label = 'body'").orderBy("first_line").collect()]
    assert [x[1] for x in body] == [1, 7, 13, 19] and {x[2] for x in body} == {regions.PAGE_HEADS}
    assert a.prefixes.where("doc_id = 2").count() == 0  # only where every line is a page
    text = a.render([render.custom("bare", ["body"], drop_furniture=True)]).where("doc_id = 1").first().text
    assert "THE CYCLONE" not in text and "It was page 0" in text


def test_page_headings_and_heads_are_merged_and_the_opening_is_kept():
    row = lambda n, title=None: {"n": n, "s": title or "x", "key": "x", "section": False, "numeral": None, "division": False, "page_heading": title, **dict.fromkeys(("front", "back", "metadata", "contents", "start_mark", "end_mark", "credit", "credit_heading"), False)}
    rows = [row(5, "CHAPTER II. THE COUNCIL"), row(15, "CHAPTER III. THE RESCUE"), row(25, "CHAPTER IV. THE FIELD")]
    series = [{"first_line": 7, "title": "THE COUNCIL"}, {"first_line": 33, "title": "THE QUEEN"}]
    found, kind, evidence, titles = regions._tier(rows, 1, 40, lambda n: False, True, series)
    assert found == [5, 15, 25, 33] and kind == "chapter" and evidence == regions.PAGE_HEADINGS and titles[33] == "THE QUEEN"
    out = regions.assemble(40, rows, list(range(1, 41)), [], True, series)
    assert [(x[2], x[3], x[4]) for x in out if x[0] == "body"][0] == (regions.OPENING, 1, 4)
    assert regions._tier(rows, 1, 40, lambda n: False, False, series)[0] == []


def test_sections_rank_by_their_dots(lines_of):
    df = lines_of("1. Introduction\n\ntext\n\n2. Data\n\ntext\n\n2.1 Method of work\n\ntext\n\n2.1.1 Details of it\n\ntext\n\n3. End of it all\n\ntext")
    got = [(r.title, r.level, r.parent) for r in regions.segment(df).where("label = 'body'").orderBy("region_idx").collect()]
    assert [x[1] for x in got] == [1, 1, 2, 3, 1] and [x[2] for x in got] == [None, None, 1, 2, None]
    words = regions.segment(df).select("doc_id", "region_idx", F.lit(1).alias("own_words"))
    total = {r.region_idx: r.total_words for r in regions.roll_up(regions.segment(df), words).collect()}
    assert total[1] == 3


def test_notes_keep_all_their_lines_on_every_route(spark):
    lines = ["CHAPTER I", "", "A text[1] with marks[2].", "", "[1] The first half of the note", "and its second half.", "", "[2]", "[7] never marked"]
    a = Analysis(docs_of(spark, lines))
    assert {(r.label, r.text, r.last_line) for r in a.notes.collect()} == {("1", "The first half of the note and its second half.", 6), ("7", "never marked", 9)}
    assert {(r.label, r.paired) for r in a.note_pairs.collect()} == {("1", True), ("2", False), ("7", False)}
    kept, removed = (a.render([render.custom(x, ["body"], footnotes=x)]).first().text for x in ("retain", "extract"))
    assert "second half" in kept and "second half" not in removed and "A text with marks[2]." in removed
    assert [r.text for r in render.extracted_notes(a.notes, a.note_pairs).collect()] == ["[1]\tThe first half of the note and its second half."]
    counts = a.removals([render.custom("x", ["body"], footnotes="remove")]).first()
    assert (counts.footnotes_removed, counts.footnote_lines_removed) == (1, 2)


def brute_pairs(events):
    open_, out = {}, []
    for line, step, label in events:
        if step > 0:
            open_.setdefault(label, []).append(line)
        else:
            out.append((label, open_[label].pop() if open_.get(label) else None, line))
    return sorted(out + [(k, x, None) for k, v in open_.items() for x in v], key=str)


def test_pairs_equal_a_stack(spark):
    import random

    r = random.Random(4)
    lines, events = [], []
    for d in range(1, 7):
        mine = []
        for n in range(1, 41):
            label, body = r.choice("123"), r.random() < 0.45
            lines.append((d, 2 * n, f"[{label}] note" if body else f"text[{label}] on"))
            mine.append((2 * n, -1 if body else 1, label))
        events.append(brute_pairs(mine))
    lines += [(d, n + 1, "") for d, n, _ in lines]
    got = notes.pairs(spark.createDataFrame(lines, "doc_id int, line_no int, line string")).collect()
    for d in range(1, 7):
        assert sorted([(x.label, x.marker_line, x.body_line) for x in got if x.doc_id == d], key=str) == events[d - 1]


def test_one_pass_over_variants_equals_one_by_one(lines_of):
    df = lines_of("Title\nby me\n\nPREFACE\n\nwords\n\nCHAPTER I\n\none  two \n\n\n\nthree\n\nCHAPTER II\n\nfour\n\nAPPENDIX\n\nfive", "plain")
    seg = regions.segment(df)
    both = {(r.doc_id, r.variant): r.text for r in render.render_all(df, seg).collect()}
    assert both == {(r.doc_id, r.variant): r.text for v in render.resolve() for r in render.render(df, seg, v).collect()}
    assert both[1, "body-only"] == "CHAPTER I\n\none  two\n\nthree\n\nCHAPTER II\n\nfour\n" and both[2, "body-no-headings"] == "plain\n"


def test_no_words_and_the_limits_themselves_are_judged(spark):
    rows = [(1, "verbatim", 0, 0), (2, "verbatim", 3000, 9), (2, "body-only", 2250, 9), (3, "verbatim", 3000, 9), (3, "body-only", 2760, 9), (4, "verbatim", 3000, 9), (4, "body-only", 2770, 9)]
    got = metrics.verdicts(render.deltas(spark.createDataFrame(rows, "doc_id int, variant string, word_tokens int, word_types int"))).collect()
    assert {(r.doc_id, r.variant): r.verdict for r in got} == {(1, "verbatim"): "RED", (2, "verbatim"): "GREEN", (2, "body-only"): "RED", (3, "verbatim"): "GREEN", (3, "body-only"): "AMBER", (4, "verbatim"): "GREEN", (4, "body-only"): "GREEN"}


def test_prepare_writes_logs_and_a_readable_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("CHAPTER I\n\nThe old draw-\nbridges by the draw and the bridges.\n")
    (tmp_path / "in" / "b.txt").write_text("nothing to see\n")
    session = CorpusSession(spark)
    out = str(tmp_path / "out")
    session.prepare(session.read(str(tmp_path / "in")), out, ["verbatim", session.variant("mine", ["body"])])
    logs = {r.doc_id: json.loads(r.log) for r in spark.read.parquet(f"{out}/log_json").collect()}
    assert {x["source"]["encoding"] for x in logs.values()} == {"utf-8"} and all(x["regions"] and x["variants"] and x["counts"] for x in logs.values())
    pages = [r.log for r in spark.read.parquet(f"{out}/log_markdown").collect()]
    assert sum("Nothing was found" in p and report.SILENT["note"] in p for p in pages) == 1 and all("--variants verbatim,mine" in p for p in pages)
    assert len(list((tmp_path / "out" / "logs").glob("*.json"))) == len(list((tmp_path / "out" / "logs").glob("*.md"))) == 2
    assert review.read(spark, f"{out}/review").count() == 0
    assert "# Review queue" in "\n".join(p.read_text() for p in (tmp_path / "out" / "review").glob("part-*"))


def test_command_line(spark, tmp_path, capsys):
    from lectern.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("CHAPTER I\n\nsome text\n")
    assert main(["inspect", str(tmp_path / "in"), "--all"]) == 0 and "uncovered lines: 0" in capsys.readouterr().out
    assert main(["clean", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--keep", "body", "--name", "mine"]) == 0
    assert {r.variant for r in spark.read.parquet(str(tmp_path / "o" / "text")).collect()} == {"mine"}
    assert main(["clean", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--keep", "bodi"]) == 2
    assert main(["clean", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--variants", "nonsense"]) == 2


def test_the_shared_folder_is_named_by_the_session(spark, tmp_path):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def setCheckpointDir(self, d):
            raise AssertionError

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = Context()

    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        with pytest.raises(RuntimeError):
            shared_dir(Session())
    else:
        assert shared_dir(Session()) == held.get()


def test_damaged_heads_merge_like_the_plain_likeness():
    import difflib
    import random

    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abcde ") for _ in range(r.randint(1, 14)))
        b = "".join(c if r.random() < 0.85 else r.choice("abcdex") for c in a)
        assert furniture.alike(a, b, 0.85) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)


def test_pdf_kinds():
    from lectern.sources import readers

    assert readers.pdf_kind(["", "", "x"]) == "image" and readers.pdf_kind(["■ " * 200]) == "unmapped"
    assert readers.pdf_kind(["some text"], "Made with ABBYY") == "ocr" and readers.pdf_kind(["some text"]) == "text" and readers.pdf_kind([]) == "text"
    assert hyphens.SUFFIX == 3
