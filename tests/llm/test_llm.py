import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import lexicon, p1_garbled, p2_markup, p3_quality, p4_lookalike, p5_scans, p6_tokens, p7_mix, p8_sentences, vocab

GERMAN = "Für die Leute in der Stadt ist der Hügel schön. Größe und Übung führen zu müden Gärtnern. "
SPANISH = "El niño miró el árbol y también el jardín según la señora. Mañana cruzó el río con atención. "
RUSSIAN = "Старый колодец у реки был закрыт, и люди в городе уже знали об этом. Никто не знал, что дом забыт. "


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- 1 -------------------------------------------------------------------------------


def corpus(spark, extra):
    clean = [GERMAN, SPANISH, RUSSIAN, "The old mill by the river was quiet, and nobody knew why.", "Le théâtre était fermé avant l’été ; où est le château ?"] * 12
    data = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, t) for i, t in enumerate(extra)]
    return spark.createDataFrame(data, "rec_id long, text string")


def test_garbled_lines_are_found_and_restored(spark):
    wrong = [
        ("Für den Hügel".encode().decode("cp1252"), "Für den Hügel"), ("el árbol y también el jardín".encode().decode("mac_roman"), "el árbol y también el jardín"),
        ("Der Hügel ist schön".encode().decode("cp437"), "Der Hügel ist schön"), (RUSSIAN.encode("cp1251").decode("latin_1"), RUSSIAN), (SPANISH.encode().decode("cp1252", "replace").encode().decode("latin_1"), None),
        ("Nadie mir� el r�o", None),
    ]
    right = ["NÃO ENTRE, SÃO JOÃO", "ÂGE et ÂME", "plain ascii", "", None, "Größe ± 3 µm"]
    got = p1_garbled.find(corpus(spark, [w for w, _ in wrong] + right), "text", ["rec_id"]).collect()
    assert {r.rec_id for r in got} == {1000 + i for i in range(len(wrong))}
    by = {r.rec_id: r for r in got}
    for i, (_, text) in enumerate(wrong):
        if text:
            assert by[1000 + i].restored == text and by[1000 + i].whole


def test_garbled_counts_lines_of_a_text_and_takes_empty_tables(spark):
    df = corpus(spark, ["first\nFür den Hügel".encode().decode("cp1252") + "\nlast"])
    assert [(r.rec_id, r._line) for r in p1_garbled.find(df, "text", ["rec_id"]).collect()] == [(1000, 2)]
    assert p1_garbled.find(df.limit(0), "text", ["rec_id"]).count() == 0


def test_segments_are_maximal_by_brute_force():
    r = random.Random(5)
    for _ in range(100):
        n = r.randint(2, 12)
        p = np.array([r.choice([200, 300, 10]) for _ in range(n)] + [10, 10], np.int64)
        score = np.array([r.uniform(-3, 3) for _ in range(n + 1)])
        found = p1_garbled._segments(p, score.copy())
        x = [-1e4 if p[i] == 10 or p[i + 1] == 10 else -score[i] for i in range(n + 1)]
        top = max(sum(x[i:j]) for i in range(n + 1) for j in range(i + 1, n + 2))
        best = max((sum(x[a : b - 1]) for a, b in found), default=None)
        assert (best is None and top < p1_garbled.SEGMENT) or best == pytest.approx(top)


# --- 2 -------------------------------------------------------------------------------


def file_lines(spark, *files):
    return spark.createDataFrame([(f, n, line) for f, lines in enumerate(files, 1) for n, line in enumerate(lines, 1)], "file_id long, line_no int, line string")


def test_markup_languages_and_decoys(spark):
    files = [
        ["plain text", "", "<h2>Head</h2>", "<ul>", "<li>one</li>", "</ul>"], ["text", "", "## Head ##", "- **bold** item", "", "```", "\\section{no}", "<b>no</b>", "```"],
        ["== Head ==", "* [[link]] text", "# numbered item"], ["\\section{Head}", "\\begin{verbatim}", "== no ==", "\\end{verbatim}", "$\\alpha=4$"],
        ["The word ____ was left blank, see [a] below.", "C:\\temp\\new\\data and keeper_list_old.txt", "* * *", "- item", "1. item", "It cost $5 and $12, 3 < 4 > 2", "The R&D hut <3 --> #1"], ["one &nbsp; mark only"], [None, ""],
    ]
    got = {(r.file_id, r.syntax) for r in p2_markup.languages(file_lines(spark, *files)).where("certainty > 0.5").collect()}
    assert got == {(1, "html"), (2, "markdown"), (3, "wiki"), (4, "latex"), (6, "html")}


def test_markup_becomes_structured_text(spark):
    got = [(r.kind, r.text) for r in p2_markup.clean(file_lines(spark, ["<h2>A &amp; B</h2>", "<li>one</li>", "<pre><code>", "x &lt; 3", "</code></pre>"])).orderBy("line_no").collect()]
    assert ("heading", "A & B") in got and ("item", "one") in got and ("code", "x < 3") in got


def test_marginals_equal_enumeration():
    import itertools

    m = p2_markup.Potentials(p2_markup.pages(60))
    blocks = [[[0], [1]], [[2]]]
    got = m.marginals(blocks)
    k, lines = len(p2_markup.SYNTAX), [x for b in blocks for x in b]
    owner = [0, 0, 1]
    total = np.zeros((len(lines), k))
    for root in range(len(m.root)):
        for bs in itertools.product(range(k), repeat=2):
            for ls in itertools.product(range(k), repeat=3):
                w = m.root[root] + sum(m.block[root, b] for b in bs) + sum(m.line[bs[owner[i]], s] + m.emission(lines[i])[s] for i, s in enumerate(ls))
                for i, s in enumerate(ls):
                    total[i, s] += np.exp(w)
    assert np.allclose(np.concatenate(got), total / total.sum(1, keepdims=True))


# --- 3 -------------------------------------------------------------------------------

COMMON = {"en": "the of and to in a is that it was for on with as by at from".split(), "de": "der die das und in den von zu".split(), "zh": ["的", "了", "在"], "ru": "и в не на что с".split()}


def test_rules_hold_on_documents_they_were_not_fitted_on(spark):
    rules = p3_quality.fit(spark, COMMON, 900)
    made = p3_quality.samples(COMMON, 240, seed=99)
    df = spark.createDataFrame([(i, k, x) for i, (_, lines) in enumerate(made) for k, x in enumerate(lines, 1)], "file_id long, line_no int, line string")
    got = {r.file_id: r["shape"] for r in p3_quality.shapes(df, COMMON, rules).collect()}
    right = sum(got[i] == shape for i, (shape, _) in enumerate(made))
    assert right >= 0.9 * len(made)


def test_stats_count_deliveries_once_and_files_without_text_have_no_shape(spark):
    df = file_lines(spark, ["the old mill of the valley.", "it was"], [None, "", "  "])
    twice = df.unionByName(df)
    got = {r.file_id: r for r in p3_quality.shapes(twice, COMMON, []).collect()}
    assert (got[1].word_count, got[1].line_count, got[1]["shape"]) == (8, 2, "prose")
    assert got[2]["shape"] is None and got[2].word_count == 0


# --- 4 -------------------------------------------------------------------------------


def test_lines_that_print_alike(spark):
    base = "The café office keeps the old ledger here"
    alike = [base, unicodedata.normalize("NFD", base), base.replace(" ", "\xa0"), base.replace("ffi", "ﬃ"), base.replace("o", "о").replace("e", "е"), base + "  ", "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base), base.replace("k", "k​")]
    other = [base.replace("é", "e"), base.upper(), "  " + base, base + ".", "short"]
    df = file_lines(spark, alike, other, [base])
    got = {tuple(r) for r in p4_lookalike.pairs(df).collect()}
    same = [(1, i + 1, t) for i, t in enumerate(alike)] + [(3, 1, base)]
    want = {(a[0], a[1], b[0], b[1]) for a in same for b in same if (a[0], a[1]) < (b[0], b[1]) and a[2] != b[2]}
    assert got == want


def test_forms_are_idempotent_and_null_safe(spark):
    df = file_lines(spark, ["аbс ＡＢＣ", None, "", "x\u200by"])
    form = p4_lookalike.fit(df.select("line"))
    got = p4_lookalike.canonical(df, "line", ["file_id", "line_no"], form)
    again = p4_lookalike.canonical(got.select("file_id", "line_no", F.col("canonical").alias("line")), "line", ["file_id", "line_no"], form)
    assert {r.line_no: r.canonical for r in got.collect()} == {r.line_no: r.canonical for r in again.collect()}
    assert p4_lookalike.pairs(df.limit(0)).count() == 0


# --- 5 -------------------------------------------------------------------------------


def scan():
    body = "In the valley the people of the mill had watched the river and the tower for many years before they".split()
    r, lines, truth = random.Random(2), [], {}
    for page in range(6):
        if page:
            lines.append("THE SILENT TOWER" if page != 3 else "THE S1LENT TOWER")
            truth[len(lines)] = "running_head"
        for k in range(12):
            words = [r.choice(body) for _ in range(9)]
            lines.append(" ".join(words))
        lines.append(f"- {page + 11} -")
        truth[len(lines)] = "page_number"
    lines[3] = "people of the val-"
    lines[4] = "ley " + lines[4]
    truth[4] = "broken_word"
    lines[17] = "tbe people of thc mill"
    truth[18] = "misread"
    return ["The Silent Tower", "", *lines], {n + 2: t for n, t in truth.items()}


def test_scans(spark):
    lines, truth = scan()
    x = spark.createDataFrame([(1, "ocr", lines, None, 1), (1, "ocr", lines, None, 2), (2, "image", None, None, 1), (3, "unmapped", lines, None, 1)], "extr_id long, kind string, text_lines array<string>, page_starts array<int>, extracted_at int")
    none = spark.createDataFrame([], "file_id long, line_no int, line string")
    cases, fix = p5_scans.found(x, none)
    assert {r.line_no: r.noise for r in cases.collect()} == truth and {r.rec_id for r in cases.collect()} == {1}
    assert {(r.word, r.right) for r in fix.collect()} == {("tbe", "the"), ("thc", "the")}
    text = " ".join(r.text for r in p5_scans.paragraphs(x, none).where("rec_id = 1").orderBy("para_no").collect())
    assert "the valley" in text and "- 12 -" not in text and "the people of the mill" in text


def test_weighted_distance():
    assert p5_scans.distance("tbe", "the") < p5_scans.COST < p5_scans.distance("txe", "the")
    assert p5_scans.distance("frorn", "from") == pytest.approx(0.3) and p5_scans.distance("same", "same") == 0


# --- 6 and 7 -------------------------------------------------------------------------


def test_lexicon_equals_a_dictionary():
    r = random.Random(1)
    words = {bytes(r.choice(b"abcde") for _ in range(r.randint(1, 7))): [r.randint(0, 99) for _ in range(r.randint(1, 4))] for _ in range(500)}
    lex = lexicon.Lexicon(lexicon.build(words))
    asked = list(words) + [b"", b"zz", b"abcdeabcde", b"a" * 9]
    for w, n in zip(asked, lex.numbers(asked)):
        assert (lex.outputs(int(n)) if n >= 0 else None) == words.get(w)
    assert lexicon.Lexicon(lexicon.build({})).numbers([b"x"]).tolist() == [-1]
    states = len(lex.final)
    assert states < len({w[:k] for w in words for k in range(len(w) + 1)})  # fewer than a trie has


def test_ids_equal_the_public_tokenizer(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=vocab.ranks(), special_tokens={})
    texts = [GERMAN, RUSSIAN, "水井已经没有了。", "", None, "   \n\n  x", "<|endoftext|> hello  world", "naïve 👩‍🚀 don't", "a" * 300, GERMAN]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in p6_tokens.encode(df, keep=["doc_id"]).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in p6_tokens.token_counts(df, keep=["doc_id"]).collect()} == {i: len(x) for i, x in got.items()}
    assert p6_tokens.encode(df.limit(0), keep=["doc_id"]).count() == 0


def test_mixing_reaches_shares_within_caps(spark):
    docs = [(i, "a" if i < 600 else "b" if i < 660 else "c" if i < 700 else None, 10 if i % 7 else 0) for i in range(900)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.2, 5), ("c", 0.4, 2), ("ghost", 0.1, 3)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in p7_mix.shares(sizes, targets).collect()}
    assert {s for s, r in report.items() if not r.reachable} == {"c", "ghost"} == {r.source for r in p7_mix.unreachable(sizes, targets).collect()}
    assert abs(report["a"].share_of_total - 0.3) < 0.02 and abs(report["b"].share_of_total - 0.2) < 0.02
    assert report["c"].mixed_docs == 80 and report["ghost"].mixed_tokens == 0
    copies = p7_mix.sample(sizes, targets).groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m")).collect()
    assert all(r.m <= {"a": 2, "b": 5, "c": 2}[r.source] for r in copies)
    drawn = p7_mix.sample(sizes, targets).where("source = 'a'").count()
    assert abs(drawn - 600 * report["a"].copies_per_doc) <= 1  # systematic: within one of what is expected


# --- 8 -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,units",
    [
        ("Dr. Ardlick met Mrs. Dov at 3 p.m. Nobody knew. It cost $ 9.40, or 1.5 per cent. more.", ["Dr. Ardlick met Mrs. Dov at 3 p.m.", "Nobody knew.", "It cost $ 9.40, or 1.5 per cent. more."]),
        ("“We stay here!” Dovrith shouted across. “The pump is lit.” The table fell.", ["“We stay here!” Dovrith shouted across.", "“The pump is lit.”", "The table fell."]),
        ("Er kam am 5. April. Es gab Seile, Teer usw. „Wo ist er?“, fragte Arddon. Man nahm z. B. den Weg.", ["Er kam am 5. April.", "Es gab Seile, Teer usw.", "„Wo ist er?“, fragte Arddon.", "Man nahm z. B. den Weg."]),
        ("“水井不见了！”科尔丹大声说。他想了想……还是去了。（仓库很方便。）", ["“水井不见了！”科尔丹大声说。", "他想了想……还是去了。", "（仓库很方便。）"]),
        ("「港だ！」とベルさんが叫んだ。塔は静かだ。", ["「港だ！」とベルさんが叫んだ。", "塔は静かだ。"]),
        ("“पुल कहाँ है?” वेलमर ने पूछा। घर खुला था।", ["“पुल कहाँ है?” वेलमर ने पूछा।", "घर खुला था।"]),
        ("«هل هذا هو السوق؟» سأل أردق. زار د. كلدان المدينة.", ["«هل هذا هو السوق؟» سأل أردق.", "زار د. كلدان المدينة."]),
        ("ท่าเรือว่างเปล่า ดร.ทอร์วินมาถึงเมื่อเช้านี้", ["ท่าเรือว่างเปล่า", "ดร.ทอร์วินมาถึงเมื่อเช้านี้"]),
        ("Πού είναι ο τοίχος; Ο κ. Αρδάκης έφυγε.", ["Πού είναι ο τοίχος;", "Ο κ. Αρδάκης έφυγε."]),
        ("«Где дом?» — спросил Велмар. В г. Сарвино проф. Келдан ушёл и т. д. А. П. Довлин пришёл.", ["«Где дом?» — спросил Велмар.", "В г. Сарвино проф. Келдан ушёл и т. д.", "А. П. Довлин пришёл."]),
        ("Home · Shop · News\nThe Old Mill\nIt fell.It rose.", ["Home · Shop · News", "The Old Mill", "It fell.", "It rose."]),
        ("Head\n\nThe sentence goes\nover the line. Next one.", ["Head", "The sentence goes\nover the line.", "Next one."]),
    ],
)
def test_sentences(spark, text, units):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = p8_sentences.units(df, content=True).orderBy("unit_no").collect()
    assert [r.unit for r in got] == units and all(text[r.start_pos : r.start_pos + r.length] == r.unit for r in got)


def test_sentences_of_nothing_and_of_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "One. Two."), (4, "One. Two."), (5, "x" * 5000 + ". " + "Y" * 10)], "doc_id long, text string")
    got = rows(p8_sentences.units(df).select("doc_id", "start_pos"))
    assert got == [(4, 0), (4, 5), (5, 0), (5, 5002)]
