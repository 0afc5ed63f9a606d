import io
import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import headings as H
from lectern.functions import text as T
from lectern.operators import furniture, hyphens, interface, metrics, notes, regions, render, review, verse
from lectern.operators import lines as L
from lectern.sources import readers

PROSE = ["It was a long road to the mill and nobody in the valley", "had walked it since the bridge fell in the spring of that", "year, so the two of them took the boat across the water and", "went on foot from there until the tower came into sight at", "last above the trees."]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_words_count_the_same_composed_or_not(spark):
    for text in ("café à la carte", "café à la carte"):
        assert one(spark, T.token_count, text) == 4
    assert one(spark, T.token_count, "one ️ two don’t o'clock 1234 _x_") == 5
    assert one(spark, T.type_count, "The the THE end") == 2


@pytest.mark.parametrize("line,number", [("42", 42), ("- 17 -", 17), ("l3", 13), ("[1O1]", 101), ("So", None), ("I", None), ("7", 7), ("", None), ("1234567", None), ("chapter 3", None)])
def test_page_numbers_allow_damage_but_make_no_numbers_of_words(spark, line, number):
    assert one(spark, T.page_number, line) == number


@pytest.mark.parametrize("text,value", [("XIV", 14), ("iv", 4), ("MCMXC", 1990), ("x1", None), ("", None)])
def test_roman(spark, text, value):
    assert one(spark, T.roman_value, text) == value


@pytest.mark.parametrize(
    "line,yes",
    [("CHAPTER IV", True), ("Chapter 1. The Beginning", True), ("Book the Third", True), ("Kapitel 3", True), ("ГЛАВА II", True), ("Section 3 of the act states that", False), ("Chapters of my life", False), ("ACT II", True), ("CHAPTER 5 " + "WHY " * 25, True), ("Chapter 5 " + "Was why " * 12, False)],
)
def test_division_headings(spark, line, yes):
    assert one(spark, H.is_division, line) is yes


def test_keys_and_labels(spark):
    assert one(spark, T.line_key, "  JANE EYRE, 42 ") == "jane eyre"
    assert one(spark, T.control_key, "340 Likes!") == "likes"
    assert one(spark, T.is_handle, "@mary.jones") and one(spark, T.is_relative_time, "9 w") and not one(spark, T.is_handle, "@ mary")
    assert one(spark, T.letter_ratio, "") == 0.0
    assert one(spark, L.newline_style, "") == "CRLF" and one(spark, L.newline_style, "a\nb\n") == "LF"


def test_explode_lines_handles_nulls_and_all_line_ends(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, L.explode_lines(docs).collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, ""), (2, 1, "")]
    assert {r.doc_id: (r.characters, r.line_count, r.word_tokens) for r in L.document_stats(docs.where("doc_id > 1")).collect()} == {2: (0, 0, 0), 3: (0, 0, 0)}


def test_hyphen_decisions_follow_the_text(lines_of):
    df = lines_of(["The lan-", "tern and the remark-", "able lantern stood by", "the half-", "forgotten gate. A half-forgotten", "end -", "of im-", "ag-", "inary things"])
    got = {r.line_no: r.decision for r in hyphens.decisions(df).collect()}
    assert got == {1: "join", 2: "join", 4: "keep", 7: "join", 8: "join"}
    out = [r.line for r in hyphens.join_lines(df, hyphens.decisions(df)).orderBy("line_no").collect()]
    assert out == ["The lantern and the remarkable lantern stood by", "the half-forgotten gate. A half-forgotten", "end -", "of imaginary things"]


def test_review_answers_apply_to_undecided_breaks_only(spark, lines_of, tmp_path):
    df = lines_of(["The old draw-", "bridges by the draw and bridges", "x lan-", "tern lantern"])
    decided = hyphens.decisions(df)
    queue = review.items(decided)
    assert review.outstanding(queue, queue.limit(0)).count() == queue.count()
    answers = spark.createDataFrame([("hyphen", "lan-tern", "keep"), ("hyphen", "draw-bridges", "drawbridges")], "kind string, key string, decision string")
    got = {r.hyphenated: (r.decision, r.resolved) for r in review.apply(decided, answers).collect()}
    assert got["lan-tern"] == ("join", "lantern")
    path = str(tmp_path / "queue")
    review.write(queue, path)
    assert review.read(spark, path).count() == 0  # all undecided


def test_furniture_needs_rising_numbers_at_even_gaps(lines_of):
    page = lambda k: ["THE SILENT TOWER", *[f"Body line {k} {i} goes on and on about {'abcdefgh'[i % 8] * 3}{k}" for i in range(20)], str(k)]
    book = list(itertools.chain.from_iterable(page(k) for k in range(1, 9)))
    got = {(r.line_no, r.rule) for r in furniture.find(lines_of(book)).collect()}
    assert {n for n, rule in got if rule == "page_number"} == set(range(22, 177, 22))
    assert {n for n, rule in got if rule == "running_head"} == set(range(1, 177, 22))
    unnumbered = [x for x in book if not x.isdigit()]
    assert furniture.find(lines_of(unnumbered)).count() == 0


def test_longest_rising_equals_brute_force():
    import random

    r = random.Random(3)
    for _ in range(60):
        v = [r.randint(1, 9) for _ in range(r.randint(0, 9))]
        best = max((len(c) for k in range(len(v) + 1) for c in itertools.combinations(v, k) if list(c) == sorted(set(c))), default=0)
        got = [v[i] for i in furniture.longest_rising(v)]
        assert len(got) == best and got == sorted(set(got))


def test_edges_of_stated_pages(spark):
    lines, starts = [], []
    for k in range(6):
        starts.append(len(lines))
        lines += ["THE OLD MILL" if k % 2 else "THE 0LD MILL", *["some text here that goes on"] * 5, str(40 + k)]
    df = spark.createDataFrame([(1, lines, starts), (2, lines, starts[:2]), (3, None, None)], "extr_id long, text_lines array<string>, page_starts array<int>")
    got = furniture.edges(df).collect()
    assert {r.doc_id for r in got} == {1} and {r.line_no for r in got if r.edge == "head"} == {s + 1 for s in starts}


def test_protected_verse_and_reflowed_prose(lines_of):
    verse_ = ["O lift the lamp,", "And let it fall,", "The night is damp,", "And over all,", "The bells ring clear,", "Across the wall."]
    df = lines_of(PROSE + [""] + verse_ + [""] + PROSE)
    spans = [(r.first_line, r.last_line) for r in verse.protected_spans(df).collect()]
    assert spans == [(7, 12)]
    texts = {r.first_line: (r.joined, r.text) for r in verse.reflow(df).collect()}
    assert texts[1] == (True, " ".join(PROSE)) and texts[7] == (False, "\n".join(verse_))
    assert verse.protected_spans(lines_of(PROSE * 4)).count() == 0


def test_interface_labels_need_records(lines_of):
    def thread(k):
        return list(itertools.chain.from_iterable([f"@user{i}", f"{i} h", f"What a long comment number {i} about the tower and the mill", "Reply", f"{i} likes"] for i in range(1, k + 1)))

    got = {r.key for r in interface.labels(lines_of(thread(7))).collect()}
    assert got == {"reply", "likes"}
    assert interface.labels(lines_of(thread(3))).count() == 0


def test_footnotes_pair_by_stack(lines_of):
    df = lines_of(["Text with a mark[1] and another[2].", "", "[1] The first note", "goes on here.", "", "[2] The second.", "", "No partner[9]. [Exit.]"])
    got = {(r.label, r.marker_line, r.body_line, r.paired) for r in notes.pairs(df).collect()}
    assert got == {("1", 1, 3, True), ("2", 1, 6, True), ("9", 8, None, False)}


BOOK = """Title of the Work
by Somebody

CONTENTS

CHAPTER I
CHAPTER II
CHAPTER III

PREFACE

A few words before.

CHAPTER I

First text here.

CHAPTER II

Second text here.

CHAPTER III

Third text.

APPENDIX

More."""


def test_segments_cover_every_line_and_keep_contents_apart(lines_of):
    df = lines_of(BOOK, "no heading at all\njust text", "", "   ")
    seg = regions.segment(df)
    assert regions.gaps(df, seg).count() == 0
    got = [(r.label, r.kind, r.first_line) for r in seg.where("doc_id = 1").orderBy("region_idx").collect()]
    assert [x for x in got if x[0] == "body"] == [("body", "chapter", 14), ("body", "chapter", 18), ("body", "chapter", 22)]
    assert ("front_matter", "contents", 4) in got and ("back_matter", "back_matter", 26) in got
    assert seg.where("doc_id = 2").first().kind == "body"


def test_hierarchy_levels(lines_of):
    df = lines_of("ACT I\n\nSCENE I\n\ntext a\n\nSCENE II\n\ntext b\n\nACT II\n\nSCENE I\n\ntext c")
    got = [(r.title, r.level, r.parent) for r in regions.segment(df).orderBy("region_idx").collect()]
    assert [(t, lv) for t, lv, _ in got] == [("ACT I", 1), ("SCENE I", 2), ("SCENE II", 2), ("ACT II", 1), ("SCENE I", 2)]
    assert [p for *_, p in got] == [None, 0, 0, None, 3]


def test_variants_nest_and_invent_nothing(lines_of):
    df = lines_of(BOOK)
    seg = regions.segment(df)
    out = render.render_all(df, seg)
    n = {r.variant: r.word_tokens for r in render.stats(out).collect()}
    assert n["verbatim"] >= n["full"] > n["body-only"] > n["body-no-headings"] > 0
    assert metrics.invented(df, out).count() == 0
    with pytest.raises(ValueError):
        render.resolve(["nonsense"])
    with pytest.raises(ValueError):
        render.custom("x", ["bodi"])
    assert render.STAGES.index("dehyphenate") < render.STAGES.index("reflow")


def test_readers():
    assert readers.detect_encoding("é".encode("utf-8-sig"))[:2] == ("utf-8-sig", True)
    assert readers.detect_encoding("é".encode("cp1252")) == ("cp1252", False, 0.5)
    assert readers.detect_newline(b"") == "CRLF" and readers.detect_newline(b"a\rb\rc") == "CR"
    page = "<html><head><title>x</title></head><body><h1>Head</h1><p>One &amp; two</p><script>no()</script><ul><li>a<li>b</ul></body></html>"
    assert readers.html_text(page) == "Head\n\nOne & two\n\na\nb\n"
    assert readers.markdown_text("# Head\n\n**bold** [link](http://x.y) keep_this_name\n") == "Head\n\nbold link keep_this_name\n"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{readers.W[1:-1]}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t><w:tab/><w:t>more</w:t></w:r></w:p></w:body></w:document>')
    assert readers.docx_text(buffer.getvalue()) == "Head\n\nText more\n"
    assert readers.load("x.doc", b"")["error"].startswith("Unsupported") and readers.load("broken.docx", b"zip")["text"] is None


def test_read_folder_and_prepare(spark, tmp_path):
    from lectern.api import CorpusSession

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(BOOK)
    (tmp_path / "in" / "b.html").write_text("<p>Hello there</p>")
    session = CorpusSession(spark)
    docs = session.read(str(tmp_path / "in"))
    assert docs.where("error is null").count() == 2
    a = session.prepare(docs, str(tmp_path / "out"), ["verbatim", "body-only"])
    assert spark.read.parquet(str(tmp_path / "out" / "text")).count() == 4 and a.uncovered().count() == 0
    assert spark.read.parquet(str(tmp_path / "out" / "log_json")).count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, line_no int, line string")
    for df in (L.blocks(empty), furniture.find(empty), hyphens.decisions(empty), verse.protected_spans(empty), interface.labels(empty), notes.pairs(empty), regions.segment(empty)):
        assert df.count() == 0


def test_scores(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b")], "doc_id int, line_no int, label string")
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "doc_id int, line_no int, label string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in metrics.per_label(t, p).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 2)}
    assert metrics.sets(t, p, ["doc_id", "line_no"]).first().recall == pytest.approx(2 / 3, abs=1e-5)


def test_stream(spark, tmp_path):
    from lectern.streaming.documents import analyse_stream

    spark.createDataFrame([(1, BOOK)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = analyse_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), lambda a, n: seen.append(a.inspect().count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen and seen[0] >= 3
