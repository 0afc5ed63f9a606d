"""The queries do their whole job: the method that is named, on all rows."""

from pyspark.sql import functions as F

from lectern.llm import deliveries, p1_garbled, p2_markup, p3_quality, p4_lookalike, p5_scans, p7_mix, p8_sentences


def test_unreachable_sources_come_from_the_mix(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, "a" if i < 40 else "b", 10) for i in range(100)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.8, 2), ("b", 0.2, 1), ("ghost", 0.1, 3), ("off", None, 3)], "source string, target_share double, max_repeats int")
    assert {r.source for r in p7_mix.unreachable(sizes, targets).collect()} == {"ghost"}  # a just reaches its share with every document at its cap
    copies = p7_mix.sample(sizes, targets, full=True).groupBy("source", "doc_id").count().collect()
    assert {(r.source, r["count"]) for r in copies} == {("a", 2), ("b", 1)} and len(copies) == 100
    drawn = p7_mix.sample
    monkeypatch.setattr(p7_mix, "sample", lambda *a, **k: drawn(*a, **k).where("doc_id <> 7"))
    assert {r.source for r in p7_mix.unreachable(sizes, targets).collect()} == {"a", "ghost"}  # a mix that lacks a document falls short


def pages(lines):
    """The lines between page numbers, so that they are a scan."""
    out = ["A Title Alone", ""]
    for k in range(4):
        out += [*lines[k::4], "", f"- {k + 11} -"]
    return out


def scans(spark, *docs):
    return spark.createDataFrame([(i, "ocr", x, None, 1) for i, x in enumerate(docs, 1)], "extr_id long, kind string, text_lines array<string>, page_starts array<int>, extracted_at int")


def none(spark):
    return spark.createDataFrame([], "file_id long, line_no int, line string")


def test_repairs_are_picked_by_neighbours_and_distance(spark):
    lines = ["the heavy leaves fall slowly over town"] * 9 + ["they never fail again with help"] * 6 + ["some leaves fa1l slowly and never fa1l again", "green fa1l blue"]
    x, text = scans(spark, pages(lines)), pages(lines)
    _, fix = p5_scans.found(x, none(spark))
    got = {(text[r.line_no - 1], r.place, r.right) for r in fix.collect()}
    assert got == {(lines[15], 2, "fall"), (lines[15], 6, "fail"), (lines[16], 1, "fall")}  # no neighbour known: the smaller distance
    shown = " ".join(r.text for r in p5_scans.paragraphs(x, none(spark)).collect())
    assert "leaves fall slowly and never fail again" in shown and "fa1l" not in shown


def test_a_real_word_may_stand_for_the_less_frequent_one(spark):
    lines = ["the ban holds still"] * 20 + ["we saw hau dogs run"] * 14 + ["ein bau steht"] * 5 + ["we saw bau dogs run"]
    _, fix = p5_scans.found(scans(spark, pages(lines)), none(spark))
    assert {(r.word, r.right) for r in fix.collect()} == {("bau", "hau")} and fix.count() == 1


def test_two_letters_read_as_one_are_found(spark):
    assert p5_scans.distance("fumace", "furnace") == p5_scans.distance("dock", "clock") == 0.3
    lines = ["the furnace by the clock was hot"] * 24 + ["the fumace by the dock was hot", "a bom boat"] + ["she was born here"] * 9
    _, fix = p5_scans.found(scans(spark, pages(lines)), none(spark))
    assert {(r.word, r.right) for r in fix.collect()} == {("fumace", "furnace"), ("dock", "clock")}  # a short word needs its neighbours


def numbered(*numbers, gap=9):
    """Pages of running text, each with its number below."""
    lines, at = ["A Title Alone"], {}
    for n in numbers:
        lines += [f"some words of line {k} that run on over the page and" for k in "abcdefghi"[:gap]]
        if n:
            lines.append(n)
            at[n] = len(lines) - 1
    return lines, at


def test_page_numbers_of_every_chain_are_found():
    front, at = numbered("i", "ii", "iii", "iv", "1", "2", "3", "4", "5", "6")
    assert set(p5_scans.furniture(front, None)) == set(at.values())
    beyond, at = numbered("1", "2", "3", "4", None, None, None, None, "9", "10", "11")
    assert set(p5_scans.furniture(beyond, None)) == set(at.values())
    damaged, at = numbered("— 55 —", "— 56 —", "— S7 —", "— 58 —")
    assert p5_scans.furniture(damaged, None)[at["— S7 —"]] == "page_number"
    first, at = numbered("S2", "53", "54")
    assert at["S2"] in p5_scans.furniture(first, None)
    word, at = numbered("S6", "S7", "S8")  # a word for the page
    assert set(p5_scans.furniture(word, None)) == set(at.values())
    chapters, at = numbered("1", "II", "2", "3", "III", "4", "5", "IV", "6")
    assert {i for n, i in at.items() if n.isdigit()} == set(p5_scans.furniture(chapters, None))  # numbers of chapters stand among those of pages


def test_short_scans_are_not_passed_over(spark):
    known = pages(["the heavy tower by the river was old"] * 24)
    x = scans(spark, known, ["He saw tbe tower and the riv-", "er there."], ["the t0wer was old"])
    files = [(7, ["Tbe heavy tower", "by the r1ver was", "old and the t0wer was"]), (8, ["the heavy t0wer", "was old"]), (9, ["the t0wer was old", "and heavy"])]
    lines = spark.createDataFrame([(f, n, t) for f, ls in files for n, t in enumerate(ls, 1)] + [(9, 1, "the t0wer was old")], "file_id long, line_no int, line string")
    got = {(r.origin, r.rec_id, r.line_no, r.noise) for r in p5_scans.found(x, lines)[0].where("not (origin = 'extractions' and rec_id = 1)").collect()}
    assert got == {("extractions", 2, 1, "misread"), ("extractions", 2, 1, "broken_word"), ("extractions", 3, 1, "misread")} | {("doc_lines", 7, n, "misread") for n in (1, 2, 3)}


def test_words_that_the_index_knows_make_a_scan_by_themselves(spark):
    known = pages(["the mill by the river was old and the tower stood there"] * 24)
    files = [(1, ["He saw tbe mill by", "thc river was old", "and the tower stood", "there was the mi11", "and the river was", "by the old tower", "there and the mill", "was by the river", "and old", "the tower was there"])]
    lines = spark.createDataFrame([(f, n, t) for f, ls in files for n, t in enumerate(ls, 1)], "file_id long, line_no int, line string")
    cases = p5_scans.found(scans(spark, known), lines)[0].where("origin = 'doc_lines'").collect()
    assert {(r.line_no, r.noise) for r in cases} == {(1, "misread"), (2, "misread"), (4, "misread")}


def test_real_words_stay_where_their_neighbours_speak_for_them(spark):
    lines = ["they had seen it and she had gone"] * 60 + ["a bad road and a bad night"] * 10
    _, fix = p5_scans.found(scans(spark, pages(lines)), none(spark))
    assert fix.count() == 0


def test_a_delivery_that_is_repeated_counts_once(spark):
    rows = [(1, n, f"only zorvath{n % 2} stood here") for n in range(1, 5)]
    lines = spark.createDataFrame(rows + rows[:2] + [(None, None, "x"), (2, 1, None)], "file_id long, line_no int, line string")
    got = deliveries.once(lines).collect()
    assert len(got) == 6 and sum(r.file_id == 1 for r in got) == 4


def test_signs_are_the_same_joined_or_shipped(spark):
    lines = spark.createDataFrame([(1, 1, "He saw tbe mill"), (1, 2, "a bro-"), (1, 3, "plain"), (2, 1, "- 12 -"), (2, 2, None), (2, 3, "Tbe!")], "file_id long, line_no int, line string")
    odd = spark.createDataFrame([("tbe",)], "low string")
    both = [{(r.file_id, r.line_no) for r in p5_scans.signs(lines, odd, small).collect()} for small in (10, 0)]
    assert both[0] == both[1] == {(1, 1), (1, 2), (2, 1), (2, 3)}


def test_chains_reach_over_any_distance():
    found = [(k * 10, k) for k in range(1, 700)]
    noise = [(k * 10 + 1 + j, 5000) for k in range(1, 700) for j in range(3)]
    assert len(p5_scans._chains(sorted(found + noise))[0]) == 699


def test_asked_words_are_the_same_joined_or_shipped(spark):
    docs = spark.createDataFrame([("extractions", 1, None, [(1, "A Tbe mill, tbe end"), (2, "tbe"), (4, None), (5, "It was tbe and www.x.example/tbe $5 {tbe}")])], "origin string, rec_id long, starts array<int>, lines array<struct<n:int,line:string>>")
    fix = spark.createDataFrame([("tbe",), ("was",)], "word string").withColumn("n", F.lit(9).cast("long"))
    fix = p5_scans.candidates(fix.select("word"), spark.createDataFrame([("the", 99), ("has", 9)], "word string, n long")).withColumnRenamed("word", "low")
    both = [p5_scans.layout(docs, fix, small).where("noise = 'asked'").collect() for small in (10, 0)]
    assert sorted(map(str, both[0])) == sorted(map(str, both[1])) and {(r.line_no, r.place, r.before, r.low, r.after) for r in both[0]} == {(1, 1, "a", "tbe", "mill"), (1, 3, "mill", "tbe", "end"), (2, 0, "", "tbe", ""), (5, 2, "was", "tbe", "and")}
    n = p5_scans.layout(docs, fix).where("noise = 'pair'").groupBy().sum("n").first()[0]
    assert n == 6  # a tbe, tbe mill, mill tbe, tbe end, was tbe, tbe and: "was" has no candidate, its pairs with others don't count


def test_distance_of_the_differing_parts_is_the_whole_distance():
    import itertools

    full = p5_scans._weighed.__wrapped__
    for w in map("".join, itertools.product("rnmcl", repeat=4)):
        for r in ("rnm", "mm", "cldn", "ncl", "d", "dnl", "rmn"):
            assert p5_scans.distance(w, r) == full(w, r) or full(w, r) > p5_scans.COST


def test_shapes_hold_on_documents_of_other_makes(spark):
    common = {"en": "the of and to in a is that it was for on with as by at from this have not are be you he she they we his her but had all one".split()}
    log = [f"2024-03-{d:02} 11:{d:02}:07,{d * 31 % 1000:03} WARN scheduler[{d * 7}]: worker {d} took {d * 13} ms" for d in range(1, 28)]
    table = ["| region | opened | closed | change |", "|:--|--:|--:|--:|", *(f"| north {k} | {k * 17} | {k * 5} | {k * 1.5:.1f} |" for k in range(20))]
    quoted = ['"station","line","height","built"', *(f'"Upper Mill {k}","green",{k * 12.25},{1800 + k}' for k in range(25))]
    recipe = ["200 g flour", "2 eggs", "1 pinch of salt", "30 ml oil", "4 onions, chopped", "1 clove garlic", "black pepper", "2 bay leaves", "500 ml stock", "1 lemon"]
    tasks = ["[ ] call the printer", "[x] order ink", "[ ] sort the shelves", "[ ] oil the press", "[x] pay the boatman", "[ ] water the plants"] * 2
    program = ["import os", "", "def total(rows, key):", "    out = 0", "    for row in rows:", "        if row[key] > 3:", "            out += row[key]", "    return out", "", "print(total(load(path), 'size'))"] * 3
    hexed = [" ".join(f"{(k * 7919 + j * 104729) % 65536:04x}" for j in range(8)) for k in range(20)]
    letter = ["Dear Anna,", "", "we came home from the lake on Sunday, and it was raining all the way. The dog did not", "like the train at all, but he slept in the end. Mother has been asking for you; she says", "that the garden is full of plums and that nobody eats them.", "", "Write soon, and tell us how the work goes. We have not heard from your brother for a", "month, which is what he does when all is well.", "", "Yours,", "Peter"]
    docs = {"table": [log, table, quoted], "list": [recipe, tasks], "prose": [program, letter], "junk": [hexed]}
    rows = [(shape, d) for shape, ds in docs.items() for d in ds]
    df = spark.createDataFrame([(i, n, x) for i, (_, d) in enumerate(rows) for n, x in enumerate(d, 1)], "file_id long, line_no int, line string")
    got = {r.file_id: r["shape"] for r in p3_quality.shapes(df, common).collect()}
    wrong = {i: (shape, got[i]) for i, (shape, _) in enumerate(rows) if got[i] != shape}
    assert len(wrong) <= 1, wrong


def test_marks_in_damaged_lines_count(spark):
    files = [["<h2>Caf\ufffd hours</h2>", "", "<p>Open at n\ufffdne</p>"], ["plain text that is\ufffd damaged", "and goes on"]]
    df = spark.createDataFrame([(i, n, x) for i, ls in enumerate(files, 1) for n, x in enumerate(ls, 1)], "file_id long, line_no int, line string")
    assert [(r.file_id, r.syntax) for r in p2_markup.languages(df).where("certainty > 0.5").collect()] == [(1, "html")]


def test_structure_is_kept():
    def units(*lines):
        return [(u[2], u[3], u[4], u[5]) for u in p2_markup.convert(list(enumerate(lines, 1)), p2_markup.potentials()) if u[5]]

    assert units("\\section{One}", "\\begin{enumerate}", "\\item \\textbf{x} and \\emph{y} with $a_1$", "\\end{enumerate}", "It is \\textbf{bold \\emph{too}} at 5\\%.") == [("heading", 2, None, "One"), ("item", 1, True, "x and y with $a_1$"), ("text", None, None, "It is bold too at 5%.")]
    got = units("## Two", "", "- **a** x", "  - [b](c.md) y", "1. `c()` z", "", "See **d**.")
    assert got == [("heading", 2, None, "Two"), ("item", 1, False, "a x"), ("item", 2, False, "b y"), ("item", 1, True, "`c()` z"), ("text", None, None, "See d.")]
    assert units("[a](b.md) **c**", "", "$$ E = mc^2 $$", "", "$$", "x + y", "$$", "", "## Two", "[d](e.md)")[1:4] == [("formula", None, None, "E = mc^2"), ("formula", None, None, "x + y"), ("heading", 2, None, "Two")]
    assert units("<ol>", "  <li>one <b>b</b></li>", "</ol>", "<h3>Three</h3>") == [("item", 1, True, "one b"), ("heading", 3, None, "Three")]


def test_frequent_spellings_are_paired_in_parts(spark):
    base = "The cafe office keeps the old ledger here"
    other = base.replace("o", "о")
    rows = [(1, n, base) for n in range(1, 8)] + [(2, n, other) for n in range(1, 6)] + [(3, 1, None), (3, 2, ""), (3, 3, base)]
    df = spark.createDataFrame(rows, "file_id long, line_no int, line string")
    got = [{tuple(r) for r in p4_lookalike.pairs(df, split=k).collect()} for k in (2, 1000)]
    assert got[0] == got[1] and len(got[0]) == 8 * 5
    assert {(r.lines, r.file_id, r.line_no) for r in p4_lookalike.classes(df).collect()} == {(8, 1, 1), (5, 2, 1)}


def test_addresses_labels_and_abbreviations(spark):
    texts = {
        "See https://a.example/search?Query=Mill&x=1.Two and go. Next one?": ["See https://a.example/search?Query=Mill&x=1.Two and go.", "Next one?"],
        "See e.g. Paris and i.e. Rome. Then go.": ["See e.g. Paris and i.e. Rome.", "Then go."],
        "Plan B. Then we left.": ["Plan B.", "Then we left."],
        "He met J. R. Smith. It was late.": ["He met J. R. Smith.", "It was late."],
        "He lives in the U.S. It is big.": ["He lives in the U.S.", "It is big."],
        "Dated Jan. 5 of that year. It ended.": ["Dated Jan. 5 of that year.", "It ended."],
        "Ask www.x.example/a?B. Then go.": ["Ask www.x.example/a?B.", "Then go."],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in p8_sentences.units(df, content=True).orderBy("unit_no").collect():
        got.setdefault(r.doc_id, []).append(r.unit)
    assert list(dict(sorted(got.items())).values()) == list(texts.values())


def test_central_european_and_turkish_text_is_restored(spark):
    pl, tr = ["zażółć gęślą jaźń na łące", "mąż i żona śpią w łóżku", "więc będą też kąpać się w rzece"], ["güneşli bir gün için şarkı söylüyoruz", "çocuğun gözleri yeşil ve ışıl ışıl", "ağaçların gölgesinde bir şey"]
    rows = [(i, x) for i, x in enumerate((pl + tr) * 60)]
    rows += [(9001, pl[0].encode("cp1250").decode("latin_1")), (9002, tr[0].encode().decode("cp1254")), (9003, pl[2].encode("iso8859_2").decode("cp1252")), (9004, None), (9005, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.restored for r in p1_garbled.find(df, "text", ["doc_id"]).collect()}
    assert got == {9001: pl[0], 9002: tr[0], 9003: pl[2]}


def test_pair_tables_grow_with_the_distinct_pairs(spark):
    import numpy as np

    r = np.random.default_rng(5)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9F00, 400))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = p1_garbled.fit(df, 14)
    assert model.bits > 14 and (np.exp(model.pairs[: 1 << model.bits]) > 0.5).mean() < 2 * p1_garbled.FILLED


def test_marginals_of_nested_elements_equal_enumeration():
    import itertools

    import numpy as np

    m = p2_markup.Potentials(p2_markup.pages(60))
    blocks = [[[0], ([1], ([2],))]]  # a line, and an element that holds a line and an element
    got = np.concatenate(m.marginals(blocks))
    k = len(p2_markup.SYNTAX)
    total, seen = np.zeros((3, k)), [m.emission([i]) for i in range(3)]
    for root in range(k):
        for b, e1, e2 in itertools.product(range(k), repeat=3):
            for ls in itertools.product(range(k), repeat=3):
                w = m.root[root] + m.block[root, b] + m.node[b, e1] + m.node[e1, e2]
                w += sum(m.line[p, s] + seen[i][s] for i, (p, s) in enumerate(zip((b, e1, e2), ls)))
                for i, s in enumerate(ls):
                    total[i, s] += np.exp(w)
    assert np.allclose(got, total / total.sum(1, keepdims=True))


def test_elements_nest():
    assert p2_markup.elements(["<div>", "<ul>", "<li>a</li>", "<li>b<br>", "</ul>", "</div>", "</p>", "<p>"]) == [(0, 5), (1, 4)]
    text = [(1, "<blockquote>"), (2, ""), (3, "words that stand alone"), (5, "</blockquote>")]
    assert [x[0] for x in p2_markup.label(text, p2_markup.potentials())] == ["html", "plain", "plain", "html"]


def test_every_file_is_looked_at(spark):
    text = [f"some words of line {k} that run on over the page and" for k in "abcdefghi"]
    heads = ["The Silent Tower", "", *text, "The Silent Tower", *text, "Tbe Silent Tower", *text]  # no number, no hyphen, one odd word
    verse = ["The boats of old go down", *["Nobody knew them all."] * 8, "", "The boats of old go down", *["Nobody knew them all."] * 8, "", "The boats of old go down", "To sea."]
    known = ["the ban holds still"] * 20 + ["we saw hau dogs run"] * 14 + ["ein bau steht"] * 5  # files that are no scans count pairs
    real = ["we saw bau dogs run", "today we saw bau dogs run"]  # odd by their neighbours only
    files = {1: heads, 2: verse, 3: known, 4: real}
    rows = [(f, n, t) for f, ls in files.items() for n, t in enumerate(ls, 1)]
    lines = spark.createDataFrame([*rows, (1, None, "a line without number"), (None, 1, "a line-"), (None, 2, "without file")], "file_id long, line_no int, line string")
    cases = p5_scans.found(scans(spark), lines)[0].where("noise <> 'misread' or rec_id <> 1").collect()
    assert {(r.rec_id, r.line_no, r.noise) for r in cases} == {(1, 12, "running_head"), (1, 22, "running_head"), (4, 1, "misread"), (4, 2, "misread")}
    shown = p5_scans.paragraphs(scans(spark), lines).collect()
    assert {r.rec_id for r in shown} == {1, 4} and " ".join(r.text for r in shown if r.rec_id == 4) == "we saw hau dogs run today we saw hau dogs run"


def test_heads_without_numbers_speak_for_a_scan_where_text_goes_on_or_nothing_else_is_like_them():
    text = ["the mill by the river was old and the tower", "stood there"] * 5
    told = lambda title, heads, text: p5_scans._furniture([title, "", *(x for h in heads for x in [*text, h]), *text], None)
    assert told("The Old Tower", ["The Old Tower", "The 0ld Tower"], text) == ({12: "running_head", 23: "running_head"}, True)
    assert told("The Old Tower", ["The Old Door", "The Old Tree"], [x + "." for x in text])[1] is False  # headings
    assert told("Boats of old go down", ["Boats of old go down"] * 2, ["Nobody knew them all."] * 9)[1] is False  # a refrain
    assert p5_scans.breaks(["ÒÑ¾\xad", "àla"], {}) == []  # no letter before the sign
