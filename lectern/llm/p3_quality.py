"""Text statistics of documents, and prose told from lists, tables and junk.

Method: an ordered rule list is induced from labelled documents by incremental
reduced-error pruning (grow a rule by information gain on two thirds of the documents,
prune it on the rest, stop when it errs too often), its thresholds are exported as one
SQL CASE expression, and that is applied to the per-document statistics.  The statistics
are counted in passes of Arrow over whole columns and summed within a task before anything
is shuffled.

The labelled documents are invented by ``samples`` (``SAMPLES`` of them, a bounded,
documented parameter) from general descriptions: columns and separators, items and marks,
alphabets of junk are drawn anew for each; all statistics of the corpus cover all lines of all documents.

Defined results: null and blank lines count as lines without text; documents without
text have statistics of zero and no shape; a line delivered twice counts once.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .deliveries import once

SAMPLES = 6000  # labelled documents the rules are fitted on
SEED = 7
SHAPES = ("junk", "table", "list")  # in the order in which rules are tried; else prose

# Marks that end a sentence, and what may follow them.
ENDS = ".!?…。！？।؟"
CLOSERS = "”“»\"')’」』）"
UNSPACED = r"[฀-๿぀-ヿ㐀-鿿]"  # scripts written without blanks
PUNCT = r"[!-&*+/:;<=>?@\\^_`|~.,]"

# between words; and what lines are searched for
BETWEEN = r"[^\p{L}\p{M}\p{N}'’-]+"
PATTERNS = {
    "ended": f"[{ENDS}][{CLOSERS}\\]\\s]*$",
    "inner": f"[\\p{{L}}\\p{{M}}]{{2}}[{ENDS}][{CLOSERS}]*(?:\\s+[“«„¿¡(\"‘—]*[\\p{{Lu}}\\p{{Lo}}]|$)|[。！？]",
    "marked": "^(?:[•*+·▪◦–-]|[0-9]{1,3}[.)])\\s+\\S",
    "url": "^(?:https?://|www\\.)\\S+$",
    "foreign": r"[\x{0080}-\x{00ff}\x{0152}-\x{0192}\x{02c6}-\x{02dc}\x{2013}-\x{2122}\x{2500}-\x{25a0}\x{fffd}]",
    "mixed": "[a-z0-9+/][A-Z].*[a-z0-9+/][A-Z0-9].*[A-Z0-9a-z][A-Z0-9]",
    "noise": PUNCT + "{2}|" + PUNCT + "[\\p{L}\\p{N}]",
}

#: per line; summed over a file's lines
LINE_STATS = ("lines", "text", "chars", "blanks", "words", "word_chars", "common", "single", "distinct", "digits", "ended", "inner", "semis", "commas", "gaps", "marked", "url", "unspaced", "foreign", "mixed", "noise", "brief", "columned", "numeric", "comma_lines")


def _unspaced(word: str) -> bool:
    return any("฀" <= c <= "๿" or "぀" <= c <= "鿿" for c in word)


def _line_stats(line: pa.Array, spaced: pa.Array, packed: str) -> dict[str, np.ndarray]:
    """``LINE_STATS`` of each line, in passes of Arrow over the whole column."""
    t = pc.utf8_trim(pc.utf8_trim_whitespace(pc.fill_null(line, "")), characters="\ufeff")
    n = len(t)
    count = lambda pattern: pc.count_substring_regex(t, pattern).to_numpy()
    holds = lambda pattern: pc.match_substring_regex(t, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.split_pattern_regex(pc.utf8_lower(t), BETWEEN)
    flat, of = pc.utf8_trim(words.flatten(), characters="'’-"), pc.list_parent_indices(words).to_numpy()
    size = pc.utf8_length(flat).to_numpy()
    flat, of, size = flat.filter(pa.array(size > 0)), of[size > 0], size[size > 0]
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    total = lambda at, weights=None: np.bincount(at, weights, minlength=n)[:n].astype(np.int64)
    known = pc.is_in(flat, value_set=spaced).to_numpy(zero_copy_only=False)
    out = {"lines": np.ones(n, np.int64), "chars": pc.utf8_length(t).to_numpy().astype(np.int64), "words": total(of), "word_chars": total(of, size), "single": total(of[size == 1])}
    out["text"] = (out["chars"] > 0).astype(np.int64)
    out["blanks"] = pc.count_substring(t, " ").to_numpy().astype(np.int64)
    out["unspaced"] = count(UNSPACED)
    out["common"] = total(of[known])
    dense = np.flatnonzero(out["unspaced"])
    if packed and len(dense):
        out["common"][dense] += pc.count_substring_regex(t.take(pa.array(dense)), packed).to_numpy()
    out["distinct"] = total(np.unique(of * (int(code.max()) + 1) + code) // (int(code.max()) + 1)) if len(code) else np.zeros(n, np.int64)
    out["digits"], out["semis"], out["commas"], out["gaps"] = count("[0-9]"), count("[;|\t]"), count(","), count(" {2,}")
    out["ended"] = holds(PATTERNS["ended"])
    out["inner"] = count(PATTERNS["inner"])
    out["marked"] = holds(PATTERNS["marked"])
    out["url"] = holds(PATTERNS["url"])
    out["foreign"] = count(PATTERNS["foreign"])
    parts = pc.split_pattern(t, " ")
    mixed = pc.match_substring_regex(parts.flatten(), PATTERNS["mixed"]).to_numpy(zero_copy_only=False)
    out["mixed"] = total(pc.list_parent_indices(parts).to_numpy()[mixed])
    out["noise"] = count(PATTERNS["noise"])
    out["brief"] = (out["words"] <= 3) * out["text"]
    out["columned"] = (out["semis"] + out["gaps"] >= 2).astype(np.int64)
    out["numeric"] = (out["digits"] * 2 > out["word_chars"]).astype(np.int64)
    out["comma_lines"] = (out["commas"] >= 1).astype(np.int64)
    return out


def file_sums(lines: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """(file_id) and the sums of ``LINE_STATS`` over its lines.  ``common``: language -> frequent words."""
    every = sorted({w.lower() for ws in common.values() for w in ws if w})
    spaced, packed = [w for w in every if not _unspaced(w)], "|".join(w for w in every if _unspaced(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(spaced, pa.string())
        for batch in batches:
            if not len(batch):
                continue
            got = _line_stats(batch.column(1), known, packed)
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            at = ids.indices.to_numpy()
            sums = [pa.array(np.bincount(at, got[c], minlength=len(ids.dictionary)).astype(np.int64)) for c in LINE_STATS]
            yield pa.RecordBatch.from_arrays([ids.dictionary, *sums], names=["file_id", *LINE_STATS])

    kind = lines.schema["file_id"].dataType.simpleString()
    parts = once(lines).select("file_id", F.col("line").cast("string")).mapInArrow(run, ", ".join([f"file_id {kind}", *(f"{c} long" for c in LINE_STATS)]))
    return parts.groupBy("file_id").agg(*[F.sum(c).alias(c) for c in LINE_STATS])


def document_stats(lines: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One row per file_id: the statistics, and the ratios that the rules look at."""
    sums = file_sums(lines, common)
    per = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)), 6)
    solid = F.col("chars") - F.col("blanks")
    return sums.select(
        "file_id", F.col("lines").alias("line_count"), F.col("text").alias("text_lines"), F.col("chars").alias("characters"), F.col("words").alias("word_count"),
        per("word_chars", "words").alias("mean_word_length"),
        F.round(F.when(solid > 0, (solid - F.col("word_chars")) / solid).otherwise(F.lit(0.0)), 6).alias("symbol_ratio"),
        per("ended", "text").alias("ended_share"),
        F.round(F.when(F.col("words") > 0, F.col("common") / (F.col("words") + F.col("unspaced") / 3.0)).otherwise(F.lit(0.0)), 6).alias("common_share"),
        per("inner", "text").alias("sentences_per_line"), per("words", "text").alias("words_per_line"), per("digits", "chars").alias("digit_share"),
        per("semis", "text").alias("separators_per_line"), per("gaps", "text").alias("gaps_per_line"), per("marked", "text").alias("marked_share"),
        per("url", "text").alias("url_share"), per("distinct", "words").alias("distinct_share"), per("single", "words").alias("single_share"),
        per("unspaced", "chars").alias("unspaced_share"), per("foreign", "chars").alias("foreign_share"), per("mixed", "text").alias("mixed_per_line"),
        per("noise", "chars").alias("noise_share"), per("brief", "text").alias("brief_share"), per("columned", "text").alias("columned_share"),
        per("numeric", "text").alias("numeric_share"), per("comma_lines", "text").alias("comma_share"),
    )


FEATURES = (
    "mean_word_length", "symbol_ratio", "ended_share", "common_share", "sentences_per_line", "words_per_line", "digit_share", "separators_per_line", "gaps_per_line",
    "marked_share", "url_share", "distinct_share", "single_share", "unspaced_share", "foreign_share", "mixed_per_line", "noise_share", "brief_share", "columned_share",
    "numeric_share", "comma_share",
)

# --- labelled documents -------------------------------------------------------------

# Letters that invented words are made of, per language.
_SOUNDS = {
    "en": ("bdfghklmnprstw", "aeiou"), "de": ("bdfghklmnrstwz", "aeiouäöü"), "fr": ("bcdfglmnprstv", "aeiouéèâ"), "es": ("bcdfglmnprstv", "aeiouáóñ"),
    "ru": ("бвгдзклмнпрст", "аеиоуы"), "el": ("βγδκλμνπρσ", "αεηιοά"), "hi": ("कगचजतदनपबमरल", "ािीुेो"), "ar": ("بتجدرسفقكلمن", "اوي"),
    "ja": ("かきくけこさしすたちつてとなにぬまみむらりる", "川木山石鳥道家町村海"), "zh": ("山水火木金土石田禾竹米虫貝車門雨風魚鳥馬", "東南西北春夏秋冬高低"), "th": ("กขคงจชดตถทนบปพมยรลวสห", "าิีุูเแโ"),
}


class _Maker:
    def __init__(self, seed: int, common: dict[str, list[str]]):
        self.r, self.common, self.pool, self.pauses, self.syllables = random.Random(seed), common, [], 0.4, (1, 3)

    def pooled(self, lang: str) -> None:
        """Lists, tables and shuffled words of one document draw from few or from many words."""
        self.pool = [self.word(lang) for _ in range(int(3 * 200 ** self.r.random()))]

    def item(self) -> str:
        return self.r.choice(self.pool)

    def word(self, lang: str) -> str:
        c, v = _SOUNDS[lang]
        if lang in ("zh", "ja"):
            return "".join(self.r.choice(c + v) for _ in range(self.r.randint(1, 3)))
        return "".join(self.r.choice(c) + self.r.choice(v) for _ in range(self.r.randint(*self.syllables))) + (self.r.choice(c) if self.r.random() < 0.7 else "")

    def sentence(self, lang: str) -> str:
        r, dense = self.r, lang in ("ja", "zh", "th")
        rate = r.uniform(0.3, 0.55)
        words = [r.choice(self.common.get(lang) or ["a"]) if r.random() < rate else self.word(lang) for _ in range(r.randint(4, 18))]
        if r.random() < 0.08:
            words.insert(r.randrange(len(words)), str(r.randint(2, 1900)))
        for _ in range(2):
            if r.random() < self.pauses and len(words) > 4:
                words[r.randrange(1, len(words) - 1)] += "、" if lang in ("ja", "zh") else "" if lang == "th" else r.choice([",", ",", ",", ";", " –"])
        if r.random() < 0.1 and not dense:
            words.insert(r.randrange(len(words)), f"{self.word(lang)}-{self.word(lang)}")
        s = ("" if dense else " ").join(words)
        s = s[0].upper() + s[1:] + ("。" if lang in ("ja", "zh") else "।" if lang == "hi" else " " if lang == "th" else r.choice("...!?…"))
        return f"“{s}”" if r.random() < 0.1 else s

    def title(self, lang: str) -> list[str]:
        """A line of one to seven words, and mostly a blank one."""
        words = [self.r.choice(self.common.get(lang) or ["a"]) if self.r.random() < 0.3 else self.word(lang).title() for _ in range(self.r.randint(1, 7))]
        return [("" if lang in ("ja", "zh", "th") else " ").join(words)] + ([""] if self.r.random() < 0.7 else [])

    def prose(self, lang: str) -> list[str]:
        r, out = self.r, []
        self.pauses, most = r.uniform(0.1, 0.9), r.choice([2, 6, 12])
        width, talk = r.choice([28, 34, 48, 60, 72, 400, 400]), r.choice(["", "", "", "", "— ", ": "])
        for _ in range(r.randint(1, 8)):
            text = ("" if lang in ("ja", "zh") else " ").join(self.sentence(lang) for _ in range(r.randint(1, most)))
            if talk:
                text = talk + text if talk == "— " else self.word(lang).title() + talk + text
            if lang in ("ja", "zh", "th"):
                out += [text[i : i + width] for i in range(0, len(text), width)]
            else:
                line = ""
                for w in text.split(" "):
                    if len(line) + len(w) > width:
                        out.append(line.strip())
                        line = ""
                    line += w + " "
                out.append(line.strip())
            out += [""] if r.random() < 0.7 else []
        if r.random() < 0.2:
            out = [x[0].upper() + x[1:] if x else x for x in out]
        if r.random() < 0.2:
            out[2:2] = self.table(lang)[: r.randint(2, 3)] if r.random() < 0.5 else self.list(lang)[: r.randint(2, 3)]
        if r.random() < 0.25:
            out[2:2] = r.choice([["<ul>", "  <li>" + self.sentence(lang) + "</li>", "</ul>"], ["## " + self.word(lang), "| a | b |", "|:--|--:|", "| 4 | 5 |"], ["\\begin{itemize}", "\\item " + self.sentence(lang), "\\end{itemize}", "\\[ \\sum_{i=1}^{3} i = n \\]"]])
        if r.random() < 0.25:
            wrong, right = r.choice(["cp1252", "latin_1", "cp437", "mac_roman", "cp1251"]), "utf_8"
            if lang in ("ru", "zh", "ja") and r.random() < 0.5:
                wrong, right = "latin_1", {"ru": "cp1251", "zh": "gb18030", "ja": "cp932"}[lang]
            turn = lambda x: "".join(bytes([b]).decode(wrong, "replace") for b in x.encode(right, "replace"))
            out = [turn(x) for x in out]
        elif r.random() < 0.06:
            out = self.code()
        elif r.random() < 0.08:
            out = [x.encode("ascii", "replace").decode().replace("?", "�") if not x.isascii() and lang in ("de", "fr", "es") else x for x in out]
        return out

    def code(self) -> list[str]:
        """A program: no prose, but something to read, and no list or table."""
        r, w, out, depth = self.r, lambda: self.word("en"), [], 0
        for _ in range(r.randint(8, 40)):
            line = r.choice([f"{w()} = {w()}({w()}, {r.randint(0, 99)})", f"if {w()} > {r.randint(0, 9)}:", f"def {w()}({w()}, {w()}):", f"return {w()}.{w()}", f"# {w()} {w()} {w()}", f"for {w()} in {w()}:", f"{w()}({w()}[{w()}])", ""])
            out.append(" " * 4 * depth + line)
            depth = min(3, depth + 1) if line.endswith(":") else max(0, depth - (r.random() < 0.4))
        return out

    def value(self, kind: str) -> str:
        """A field of a table or a list."""
        r = self.r
        return {
            "count": lambda: str(r.randint(1, 10 ** r.randint(1, 5))),
            "amount": lambda: f"{r.uniform(0, 10 ** r.randint(1, 4)):.{r.choice([1, 2, 2, 3])}f}",
            "word": self.item,
            "name": lambda: self.item().title(),
            "names": lambda: f"{self.item().title()} {self.item().title()}",
            "year": lambda: str(r.randint(1500, 2030)),
            "date": lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
            "clock": lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}",
            "rate": lambda: f"{r.randint(0, 100)}%",
        }[kind]()

    def table(self, lang: str) -> list[str]:
        """Rows of one make: typed columns parted by one separator or set at fixed widths; or lines of a log."""
        self.pooled(lang)
        r, n = self.r, self.r.randint(4, 40)
        if r.random() < 0.1:
            return [f"{self.value('date')} {self.value('clock')}:{r.randint(0, 59):02} {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} {self.item()}: {self.item()} {self.item()} {r.randint(1, 999)}" for _ in range(n)]
        numbers, words = ("count", "amount", "amount", "year", "date", "clock", "rate"), ("word", "name", "names")
        kinds = [r.choice(numbers if r.random() < r.choice([0.4, 0.6, 1.0]) else words) for _ in range(r.randint(3, 9))]
        if not any(k in numbers for k in kinds):
            kinds[-1] = r.choice(numbers)
        rows = [[self.value(k) for k in kinds] for _ in range(n)]
        if r.random() < 0.4:
            rows.insert(0, [self.item().title() for _ in kinds])
        style = r.choice(["sep", "sep", "wide", "wide", "quoted", "bars"])
        if style == "wide":
            gap = r.randint(2, 5)
            width = [max(len(row[k]) for row in rows) + gap for k in range(len(kinds))]
            left = r.random() < 0.6
            return ["".join(x.ljust(m) if left and k in words else x.rjust(m) for x, m, k in zip(row, width, kinds)) for row in rows]
        if style == "bars":
            lines = ["| " + " | ".join(row) + " |" for row in rows]
            return [lines[0], "|" + "---|" * len(kinds), *lines[1:]]
        sep = r.choice(["\t", ";", "|", " | ", ",", "; "])
        return [sep.join(f'"{x}"' if style == "quoted" and k in words else x for x, k in zip(row, kinds)) for row in rows]

    def list(self, lang: str) -> list[str]:
        """Items of one make, each on its line with or without a mark; or runs of items parted by one separator."""
        self.pooled(lang)
        r, n, w = self.r, self.r.randint(4, 50), self.item
        if r.random() < 0.2:
            sep, k = r.choice(["; ", ", ", " · ", " / "]), r.randint(3, 9)
            return [sep.join(w() for _ in range(k if r.random() < 0.5 else r.randint(3, 10))) for _ in range(n)]
        mark = r.choice([lambda i: "", lambda i: "", lambda i: "", lambda i: f"{i + 1}. ", lambda i: f"{i + 1}) ", *(lambda i, m=m: m + " " for m in "•-*–+·")])
        site = lambda: f"{r.choice(['https://', 'http://', 'https://www.'])}{self.word('en')}.example/{self.word('en')}" + (f"/{r.randint(1, 99)}" if r.random() < 0.5 else "")
        entry = lambda: f"{w().title()}, {r.randint(1, 400)}" + "".join(f", {a}–{a + r.randint(1, 90)}" for a in [r.randint(1, 400) for _ in range(r.randint(0, 2))])
        body = r.choice([
            entry, entry, w, w, lambda: w().title(), lambda: f"{w()} {w()}", lambda: f"{w().title()} {w()}", lambda: f"{w()} {w()} {w()}", lambda: f"{w().title()}, {w().title()}", lambda: f"{w().title()}, {w().title()}", lambda: f"{w()} ({w()})",
            lambda: f"{r.randint(1, 12)} x {w()} ({w()})", lambda: f"{r.randint(1, 900)} {r.choice(['g', 'kg', 'ml', 'cups', 'x'])} {w()}", lambda: f"{w()}: {w()}", site,
        ])
        return [mark(i) + body() for i in range(n)]

    def junk(self, lang: str) -> list[str]:
        """Nothing to read: characters without words, encoded data, or words without sense.  All alphabets are drawn anew."""
        r, n = self.r, self.r.randint(4, 40)
        letters, marks = string.ascii_lowercase, string.punctuation
        some = lambda pool, least, most: "".join(r.sample(pool, min(len(pool), r.randint(least, most))))
        chars = lambda pool, k: "".join(r.choice(pool) for _ in range(k))
        kind = r.choice(["mash", "mash", "noise", "noise", "coded", "coded", "marks", "shout", "echo", "salad", "salad"])
        short, long = r.randint(1, 4), r.randint(5, 12)
        if kind == "mash":  # letters at random
            pool = some(letters + (string.ascii_uppercase if r.random() < 0.2 else ""), 6, 26)
            make = lambda: " ".join(chars(pool, r.randint(short, long)) for _ in range(r.randint(3, 14)))
        elif kind == "noise":  # letters, digits and marks at random
            pool = some(letters, 2, 10) + some(string.digits, 1, 5) + some(string.ascii_uppercase, 1, 6) + some(marks, 2, 8)
            make = lambda: " ".join(chars(pool, r.randint(1, short + 4)) for _ in range(r.randint(5, 18)))
        elif kind == "coded":  # a fixed alphabet of a power of two, in groups or unbroken
            pool = (string.ascii_letters + string.digits + some(marks, 2, 24))[: r.choice([32, 64, 64, 85])] if r.random() < 0.6 else string.digits + "abcdef"
            group, width = r.choice([0, 0, 2, 4, 8]), r.randint(40, 100)
            make = lambda: " ".join(chars(pool, group) for _ in range(width // (group + 1))) if group else chars(pool, width)
        elif kind == "marks":  # marks alone
            pool = some(marks, 3, 14) + " " * r.randint(0, 3)
            make = lambda: chars(pool, r.randint(15, 70))
        elif kind == "shout":  # capitals at random and runs of marks
            pool, run = some(string.ascii_uppercase, 8, 26), some("!?.:,*#$%", 2, 6)
            make = lambda: " ".join(chars(pool, r.randint(short + 2, long + 2)) for _ in range(r.randint(3, 9))) + r.choice(["", " "]) + chars(run, r.randint(2, 7))
        elif kind == "echo":  # a few words over and over
            few = [self.word(lang) for _ in range(r.randint(1, 4))]
            make = lambda: " ".join(few * r.randint(3, 8))
        else:  # words in no order, without marks
            own = [self.word(lang) for _ in range(int(8 * 40 ** r.random()))]
            own += r.sample(self.common.get(lang) or own, min(len(self.common.get(lang) or own), r.randint(0, 6))) + (["-".join((self.word(lang), self.word(lang)))] if r.random() < 0.5 else [])
            low, high = r.randint(4, 7), r.randint(8, 14)
            make = lambda: ("" if lang in ("zh", "ja") and r.random() < 0.2 else " ").join(r.choice(own) for _ in range(r.randint(low, high)))
        return [make() for _ in range(n)]


def samples(common: dict[str, list[str]], n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """``n`` labelled documents of invented text: (shape, lines)."""
    make, out = _Maker(seed, common), []
    langs = sorted(_SOUNDS)
    for i in range(n):
        shape = ("prose", "prose", "list", "prose", "table", "junk")[i % 6]
        lang = langs[make.r.randrange(len(langs))] if make.r.random() < 0.75 else "en"
        make.syllables = make.r.choice([(1, 3), (1, 3), (1, 4), (2, 4), (2, 5)])
        lines = getattr(make, shape)(lang)
        if make.r.random() < 0.6:
            lines = [*make.title(lang), *lines]
        if shape != "prose" and make.r.random() < 0.1:
            lines = [make.sentence(lang), *lines]
        out.append((shape, lines))
    return out


# --- incremental reduced-error pruning ---------------------------------------------

Condition = tuple[str, str, float]  # feature, "<=" or ">=", threshold
CUTS = 60  # thresholds tried per feature
ERRS = 0.03  # a rule may err so often
TRIES = 10  # splits tried for a rule
SUPPORT = 0.01  # of the documents of its shape a rule must cover so many


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, op, cut in rule:
        v = x[:, FEATURES.index(f)]
        out &= v <= cut if op == "<=" else v >= cut
    return out


def _grow(pos: np.ndarray, neg: np.ndarray, first: int | None = None) -> list[Condition]:
    """Add the condition of most information gain until no negative is left (or six are there); ``first``: the feature to begin with."""
    rule: list[Condition] = []
    while len(pos) and len(neg) and len(rule) < 6:
        base = np.log2(len(pos) / (len(pos) + len(neg)))
        best: tuple[float, Condition] | None = None
        for k, f in enumerate(FEATURES):
            if first is not None and not rule and k != first:
                continue
            values = np.unique(np.concatenate([pos[:, k], neg[:, k]]))
            if len(values) < 2:
                continue
            cuts = np.round((values[:-1] + values[1:]) / 2, 5)[:: max(1, len(values) // CUTS)]
            a, b = np.sort(pos[:, k]), np.sort(neg[:, k])
            for op, p, q in (
                ("<=", np.searchsorted(a, cuts, "right"), np.searchsorted(b, cuts, "right")),
                (">=", len(a) - np.searchsorted(a, cuts, "left"), len(b) - np.searchsorted(b, cuts, "left")),
            ):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + q, 1)) - base), -1.0)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0] + 1e-9:
                    best = (float(gain[i]), (f, op, float(cuts[i])))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        pos, neg = pos[_holds(rule, pos)], neg[_holds(rule, neg)]
    return rule


def _prune(rule: list[Condition], pos: np.ndarray, neg: np.ndarray) -> list[Condition]:
    """The leading conditions that do best on documents the rule was not grown on."""

    def worth(r: list[Condition]) -> float:
        p, q = int(_holds(r, pos).sum()), int(_holds(r, neg).sum())
        return (p - q) / (p + q) if p + q else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), len(r)))


def induce(labels: list[str], x: np.ndarray, seed: int = SEED) -> list[tuple[str, list[Condition]]]:
    """The ordered rule list: (shape, conditions); where none holds, it's prose."""
    rng, rules, labels = np.random.default_rng(seed), [], np.asarray(labels)
    for shape in SHAPES:
        every = int((labels == shape).sum())
        while True:
            pos, neg = x[labels == shape], x[labels != shape]
            best: tuple[int, list[Condition]] | None = None
            # splits into growing and pruning documents; where none gives a rule, one that begins with each feature
            for first in (*[None] * TRIES, *range(len(FEATURES))) if len(pos) >= 3 else ():
                if first is not None and best is not None:
                    break
                p, q = rng.permutation(pos), rng.permutation(neg)
                a, b = max(1, 2 * len(p) // 3), 2 * len(q) // 3
                rule = _grow(p[:a], q[:b], first)
                if not rule:
                    continue
                rule = _prune(rule, p[a:], q[b:])
                hit, miss = int(_holds(rule, p).sum()), int(_holds(rule, q).sum())
                if hit >= max(1, SUPPORT * every) and miss <= ERRS * hit and (best is None or hit - 10 * miss > best[0]):
                    best = (hit - 10 * miss, rule)
            if best is None:
                break
            rules.append((shape, best[1]))
            left = ~_holds(best[1], x)
            x, labels = x[left], labels[left]
    return rules


def to_case(rules: list[tuple[str, list[Condition]]]) -> str:
    """The rule list as a SQL CASE expression over the columns of :func:`document_stats`."""
    whens = " ".join(f"WHEN {' AND '.join(f'{f} {op} {x}' for f, op, x in rule)} THEN '{shape}'" for shape, rule in rules)
    return f"CASE WHEN text_lines = 0 THEN NULL {whens} ELSE 'prose' END"


def fit(spark: SparkSession, common: dict[str, list[str]], n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, list[Condition]]]:
    """Rules from ``n`` labelled documents, whose statistics are taken as those of the corpus are."""
    made = samples(common, n, seed)
    rows = [(i, k, line) for i, (_, lines) in enumerate(made) for k, line in enumerate(lines, 1)]
    got = document_stats(spark.createDataFrame(rows, "file_id long, line_no int, line string"), common).collect()  # n rows
    got = sorted(got, key=lambda r: r["file_id"])
    return induce([made[r["file_id"]][0] for r in got], np.array([[float(r[f]) for f in FEATURES] for r in got]), seed)


def shapes(lines: DataFrame, common: dict[str, list[str]], rules: list[tuple[str, list[Condition]]] | None = None) -> DataFrame:
    """:func:`document_stats` with ``shape``: prose, list, table or junk; null without text."""
    rules = fit(lines.sparkSession, common) if rules is None else rules
    return document_stats(lines, common).withColumn("shape", F.expr(to_case(rules)))


def common_words(table: DataFrame) -> dict[str, list[str]]:
    """Language -> frequent words, from the (fixed, small) table of common words."""
    out: dict[str, list[str]] = {}
    for row in table.where("lang is not null and word is not null").groupBy("lang").agg(F.sort_array(F.collect_set("word")).alias("w")).collect():
        out[row["lang"]] = row["w"]
    return out
