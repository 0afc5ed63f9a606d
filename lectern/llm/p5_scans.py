"""Text of scanned pages: page furniture, broken and misread words, and the repaired paragraphs.

Method: a symmetric-delete index over the corpus's frequency lexicon generates candidates for
words that are rare against them; a weighted edit distance with confusion pairs, and the counts
of the neighbouring word pairs, pick the repair in each place or keep the word as it is.  Running
heads, page numbers and broken words are found in the order of each document's lines.

Extractions of kind text and ocr are scans as such.  A file of doc_lines is one if it has page
furniture or at least two lines that end in a broken word or hold a misread one: all files are
brought together and laid out, and only what was found in them decides.  Pairs of words are
counted in all of them.

Defined results: null and blank lines are never cases; repeated deliveries count once (the last
extraction, the greatest line), in the lexicon too; words of scripts without blanks (Han, kana,
Thai and the like) have no confusion pairs and aren't in the lexicon; an empty corpus has an empty
lexicon.  Furniture is looked for among lines of up to ``HEAD_LINE`` characters.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, if_small
from .deliveries import once

# What characters are misread as (right -> wrong, with a cost below that of any other edit).
CONFUSED = {
    "e": ("c",), "a": ("@",), "o": ("0",), "i": ("|", "1", "!"), "s": ("5", "$"), "l": ("1", "|", "!"), "é": ("6",), "ó": ("6",), "h": ("li", "b"), "g": ("9",), "t": ("+",), "b": ("6", "8"),
    "m": ("rn",), "u": ("ii",), "ü": ("ii",), "w": ("vv",), "n": ("u",), "d": ("cl",), "q": ("9",), "z": ("2",), "k": ("lc",), "á": ("@",), "í": ("|",), "ñ": ("u",),
}
#: characters that stand for letters, and the letters they may stand for
INTRUDERS = {"@": "a", "0": "o", "1": "li", "|": "il", "5": "s", "6": "éb", "9": "g", "+": "t", "$": "s", "8": "bs", "!": "il", "2": "z"}
# Words after a hyphen that was left hanging.
HANGING = {"and", "or", "nor", "to", "und", "oder", "bis", "sowie", "bzw", "et", "ou", "y", "e", "o", "u", "ni", "и", "или"}
# Words that name a division in a running head, and that number a page.
DIVISION = "chapter|book|part|act|section|letter|canto|kapitel|buch|teil|abschnitt|band|chapitre|livre|partie|tome|capítulo|capitulo|libro|parte|tomo|глава|часть|книга|том|κεφάλαιο"
PAGE = "page|pag|p|pg|seite|s|página|pág|folio|стр|с|σελ"

SIMILAR = 0.74  # likeness from which two head lines count as one, damage allowed for
RARER = 6  # a misread word is at least so many times rarer than the word it stands for
KNOWN = 3  # occurrences from which a word is in the lexicon
SMALL = 200_000  # a table of words up to so many rows (counted) is broadcast
PAIRS = 1_000_000  # the same for pairs of words, held as hashes
HEAD_LINE = 90  # longest line of furniture
COST = 0.6  # largest weighted distance of a repair
SIGN = 0.4  # the same for each digit or sign in an odd form
WEIGHT = 6.0  # of the weighted distance against the logarithm of pair counts: 0.3 more needs pairs six times as frequent

HYPHENS = "-‐‑¬­⸗"
# what the engine of Arrow searches lines for (it has no look-ahead)
ENDS = rf"[\p{{L}}\p{{M}}][{HYPHENS}]\s*$"
NUMBER = rf"(?i)^\s*[-–—\[(|<~*]*\s*(?:(?:{PAGE})\.?\s*)?[0-9ilosbz|!]{{1,5}}(?:\s*(?:of|de|von|/|из)\s*[0-9ilos|!]{{1,5}})?\s*[-–—\])|.>~*]*\s*$|^\s*[-–—\[(]*\s*[ivxlc]{{1,7}}\s*[-–—\]).]*\s*$"
NUMBERED = r"^\s*[0-9IlOoSBZ|!]{1,5}(?:\s{2,}|\t)\S.{2,}$|\S(?:\s{2,}|\t)[0-9IlOoSBZ|!]{1,5}\s*$"
MISREAD = r"(?:^|[\s“„«(])\p{Lu}?[a-zà-öø-ÿ]+[01569@|+$!][a-zà-öø-ÿ]{2,}(?:[\s.,;:?!)”“»\]]|$)"  # one sign or digit inside a word
# between words; scripts without blanks have no words to count
BETWEEN = r"(?:[^\p{L}\p{M}0-9@|!+$]|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])+"

_WORD = re.compile(r"[“„«\"(]*[^\W\d_]?[^\W\d_A-ZÀ-ÖØ-Þ]*(?:['’-][^\W\d_]+)?[.,;:?!)”“»\"]*$")
_HYPHEN = re.compile(r"([^\W\d_]+)[-‐‑¬­⸗]\s*$")
_NUMBER = re.compile(rf"(?i)^\s*([-–—\[(|<~*]*)\s*(?:({PAGE})\.?\s*)?([0-9ilosbz|!]{{1,5}})(?:\s*(?:of|de|von|/|из)\s*[0-9ilos|!]{{1,5}})?\s*([-–—\])|.>~*]*)\s*$")
_ROMAN = re.compile(r"(?i)^\s*([-–—\[(]*)\s*([ivxlc]{1,7})\s*([-–—\]).]*)\s*$")
_FRONT = re.compile(r"^\s*([0-9IlOoSBZ|!]{1,5})(?:\s{2,}|\t)(\S.{2,})$")
_BACK = re.compile(r"^\s*(\S.*?\S)(?:\s{2,}|\t)([0-9IlOoSBZ|!]{1,5})\s*$")
_APART = re.compile(r"[\W\d_]+").sub
_CLOSED = re.compile(r"[.!?…,;:]\W*$")
_ENDED = re.compile(r"[.!?…:;。！？।؟۔]\W*$")
_READ = frozenset("0123456789IilOoSsBbZz|!")  # digits, and what is read for them
_DIVIDED = re.compile(rf"(?i)^\W*(?:{DIVISION})\W+\w{{1,8}}\W*$")


def _value(text: str) -> int | None:
    """The number a damaged string of digits stands for; None with anything else in it."""
    if not any(c.isdigit() for c in text) and (len(text) > 3 or not any(c in "lIOS|B" for c in text)):
        return None
    text = text.translate(str.maketrans({"I": "1", "i": "1", "l": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2"}))
    return int(text) if text.isdigit() else None


def _roman(text: str) -> int | None:
    digits = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    total = last = 0
    for c in reversed(text.lower()):
        total += digits[c] if digits[c] >= last else -digits[c]
        last = max(last, digits[c])
    return total or None


@lru_cache(8192)
def _key(text: str) -> str:
    return _APART(" ", text).strip().lower()


@lru_cache(8192)
def _pairs(text: str) -> frozenset:
    return frozenset(zip(text, text[1:]))


@lru_cache(65536)
def _alike(a: str, b: str, least: float = SIMILAR) -> bool:
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    if a == b:
        return True
    x, y = set(a), set(b)
    if 2 * min(len(a) - len(x - y), len(b) - len(y - x)) < least * (len(a) + len(b)) - 1e-9:
        return False  # characters that only one has match nothing
    x, y = _pairs(a), _pairs(b)
    if len(x & y) < 0.45 * min(len(x), len(y)):
        return False  # so few common pairs of characters that the exact measure can't reach ``least``
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def _chains(found: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The chains of (position, number) that count pages, in steps of one to three, the longest first; no position is in two."""
    best: list[tuple[int, int]] = []  # (length, previous)
    seen: dict[int, tuple[list[int], list[tuple[int, int]]]] = {}  # number -> positions, the best (length, index) up to each
    for j, (pos, n) in enumerate(found):
        top = (0, -1)
        for step in (1, 2, 3):
            places, tops = seen.get(n - step, ((), ()))
            k = bisect_right(places, pos - 4 * step)
            if k:
                top = max(top, tops[k - 1])
        best.append((top[0] + 1, top[1]))
        places, tops = seen.setdefault(n, ([], []))
        places.append(pos)
        here = (best[j][0], j)
        tops.append(max(tops[-1], here) if tops else here)
    out, used = [], set()
    for j in sorted(range(len(best)), key=lambda k: -best[k][0]):
        chain = []
        while j >= 0 and found[j][0] not in used:
            used.add(found[j][0])
            chain.append(found[j])
            j = best[j][1]
        if chain:
            out.append(chain[::-1])
    return sorted(out, key=len, reverse=True)


def _rising(found: list[tuple[int, int]]) -> set[int]:
    """Positions of the longest chain."""
    return {i for i, _ in max(_chains(found), key=len, default=[])}


def _pages(numbers: dict[str, list[tuple[int, int]]], dress: dict[int, tuple]) -> set[int]:
    """Positions of page numbers: the longest chain, and what else counts pages before, between or after.

    Of each style the longest further chain, and all of at least two numbers in one dress, if its
    numbers stand about as far apart as those of the longest and not among those of another
    (numbers of chapters or verses do neither).
    """
    chains = sorted(((chain, k == 0) for found in numbers.values() for k, chain in enumerate(_chains(found))), key=lambda c: -len(c[0]))
    if not chains:
        return set()
    apart = lambda c: (c[-1][0] - c[0][0]) / (c[-1][1] - c[0][1])  # noqa: E731 - lines a page
    held = [chains[0][0]]
    for chain, longest in chains[1:]:
        if len(chain) < 2 or not (longest or len({dress[i] for i, _ in chain}) == 1):
            continue
        if 0.4 <= apart(chain) / apart(held[0]) <= 2.5 and all(chain[-1][0] < c[0][0] or chain[0][0] > c[-1][0] for c in held):
            held.append(chain)
    return {i for c in held for i, _ in c}


def furniture(lines: list[str], starts: list[int] | None) -> dict[int, str]:
    """0-based position -> 'running_head' or 'page_number'."""
    return _furniture(lines, starts)[0]


def _goes_on(before: str, after: str) -> bool:
    """Running text goes on from the one line to the other."""
    return after.lstrip()[:1].islower() and re.search(r"[^\W\d_][,–—-]?\s*$", before) is not None and _reads(before) and _reads(after)


def _furniture(lines: list[str], starts: list[int] | None) -> tuple[dict[int, str], bool]:
    """:func:`furniture`, and whether it speaks for a scan by itself.

    The title again at even distances, without any number, may also be a refrain, a heading or a row of a list: it does
    if text goes on across half of these lines, or if all are much the same and narrower than the text, and not all stand
    between blank lines where a sentence has ended, as headings do.
    """
    told = True
    text = [x or "" for x in lines]
    bare = [x.strip() for x in text]
    full = [i for i, x in enumerate(bare) if x]
    if len(full) < 6 and not starts:
        return {}, told
    edge: set[int] = set()
    starts = sorted({s for s in starts or [] if 0 <= s < len(text)})
    for s in starts:
        at = next((k for k, i in enumerate(full) if i >= s), len(full))
        edge.update(full[at : at + 3])
        edge.update(full[max(0, at - 3) : at])
    numbers: dict[str, list[tuple[int, int]]] = {}
    inline: list[tuple[int, int]] = []
    dress: dict[int, tuple] = {}
    for i in full:
        x, s = text[i], bare[i]
        if len(x) > HEAD_LINE:
            continue
        brief = len(s) <= 40 and (len(s) <= 7 or not _READ.isdisjoint(s))
        if brief and (m := _NUMBER.match(x)):
            worn = (m.group(1).strip("|<~*"), m.group(4).strip("|.>~*"))
            # a letter right before the digits may be a damaged digit as well as a word for a page
            if (m.group(2) or "") in ("s", "S") and m.end(2) == m.start(3) and (n := _value(m.group(2) + m.group(3))) is not None:
                numbers.setdefault("digits", []).append((i, n))
                dress[i] = ("digits", *worn)
            if (n := _value(m.group(3))) is not None:
                numbers.setdefault("digits", []).append((i, n))
                dress[i] = ("digits", *worn)
        if brief and (m := _ROMAN.match(x)):  # i, ii and iii are Roman numbers as well as damaged digits
            if (n := _roman(m.group(2))) is not None:
                numbers.setdefault("roman", []).append((i, n))
                dress[i] = ("roman", m.group(2).isupper(), m.group(1), m.group(3).strip("."))
        wide_gap = "  " in s or "\t" in s
        if wide_gap and s[0] in _READ and (m := _FRONT.match(x)):
            if (n := _value(m.group(1))) is not None and any(c.isalpha() for c in m.group(2)):
                inline.append((i, n))
        elif wide_gap and s[-1] in _READ and (m := _BACK.match(x)):
            if (n := _value(m.group(2))) is not None and any(c.isalpha() for c in m.group(1)):
                inline.append((i, n))
    out: dict[int, str] = {}
    own = _pages(numbers, dress)
    heads = _rising(inline)
    if len(own) + len(heads) < 2 and not (edge and len(own) + len(heads) == 1):
        own, heads = set(), set()
    out.update({i: "page_number" for i in own if len(own) > 1 or i in edge})
    # a number the chain does not hold, but at an edge and in the dress of those it holds
    if starts:
        out.update({i: "page_number" for v in numbers.values() for i, _ in v if i in edge and (own or len(v) > 1)})
    dense = len(inline) > 0.3 * len(full)  # a table, not heads
    if not dense and (len(heads) > 1 or heads & edge):
        out.update({i: "running_head" for i in heads})
        if starts:
            out.update({i: "running_head" for i, _ in inline if i in edge and i not in out})
    marks = set(out)
    near: set[int] = set(edge)
    where = {i: k for k, i in enumerate(full)}
    for i in marks:
        k = where[i]
        near.update(full[max(0, k - 3) : k + 4])
    title = _key(text[full[0]])
    wide = sorted(len(bare[i]) for i in full)[int(0.8 * len(full))]
    least, most = SIMILAR / (2 - SIMILAR) * len(title), (2 - SIMILAR) / SIMILAR * len(title)

    def brief_lines() -> Iterator[tuple[int, str]]:
        """(position, key) of short lines that are no furniture yet."""
        for i in full[1:]:
            s = bare[i]
            if len(s) <= 60 and i not in out and (s[-1].isalnum() or not _CLOSED.search(text[i].rstrip("”’\"'"))) and len(key := _key(text[i])) >= 3:
                yield i, key

    if marks or edge:
        short = dict(brief_lines())
        like_title = [i for i, key in short.items() if least <= len(key) <= most and _alike(key, title)]
        groups: list[list[int]] = []
        keys = {_key(text[i]) for i in out if out[i] == "running_head"}
        narrow = [i for i in short if i in near and (len(bare[i]) <= 0.75 * wide or _DIVIDED.match(text[i])) and any(c.isalpha() for c in text[i])]
        homes: dict[str, list[int]] = {}
        for i in narrow:
            key = short[i]
            if key not in homes:
                homes[key] = next((g for g in groups if _alike(key, _key(text[g[0]]), 0.85)), None) or []
                if not homes[key]:
                    groups.append(homes[key])
            homes[key].append(i)
        for g in groups:
            key = _key(text[g[0]])
            touching = [i for i in g if i in edge or any(j in marks for j in full[max(0, where[i] - 2) : where[i] + 3])]
            if len(g) > 1 and text[g[0]].strip()[:1].isupper() or any(_DIVIDED.match(text[i]) for i in g) or any(_alike(key, k) for k in keys):
                out.update({i: "running_head" for i in touching})
        # the title again, or a head that was found, wherever the page's number was lost
        again = {_key(text[i]) for i, kind in out.items() if kind == "running_head"}
        out.update({i: "running_head" for i in like_title if i in near or text[i].isupper() and len(again) > 0})
        if again:
            out.update({i: "running_head" for i in short if i not in out and i not in like_title and bare[i].isupper() and any(_alike(short[i], k, 0.8) for k in again)})
    else:
        like_title, gaps = [], []
        for i, key in brief_lines():
            if least <= len(key) <= most and _alike(key, title):
                gaps.append(i - [full[0], *like_title[-1:]][-1])
                like_title.append(i)
                if gaps[-1] < 8:
                    break
        if len(gaps) >= 2 and min(gaps) >= 8 and max(gaps) <= 2.5 * min(gaps):
            out.update({i: "running_head" for i in like_title})
            crossed = [i for i in like_title if where[i] + 1 < len(full) and _goes_on(text[full[where[i] - 1]], text[full[where[i] + 1]])]
            usual = sorted(len(bare[i]) for i in full)[len(full) // 2]
            set_off = all(where[i] + 1 < len(full) and full[where[i] - 1] < i - 1 and full[where[i] + 1] > i + 1 and _ENDED.search(bare[full[where[i] - 1]]) for i in like_title)
            told = 2 * len(crossed) >= len(like_title) or not set_off and all(len(bare[i]) <= 0.75 * usual and _alike(_key(text[i]), title, 0.85) for i in like_title)
    out.pop(full[0], None)
    return out, told


def _sound(part: str) -> bool:
    """Letters of one script, with capitals only in front or throughout: no garbled text."""
    if not part.isalpha():
        return False
    one = all(c < "\u0250" for c in part) or all("\u0370" <= c <= "\u03ff" or "\u1f00" <= c <= "\u1fff" for c in part) or all("\u0400" <= c <= "\u04ff" for c in part) or all(c > "\u0530" for c in part)
    return one and (len(part) < 2 or part.isupper() or part[1:] == part[1:].lower())


def breaks(lines: list[str], drop: dict[int, str]) -> list[tuple[int, int, str, str, bool]]:
    """(line, next line, left, right, hanging): words that go on in the next line of running text."""
    out = []
    for i, x in enumerate(lines):
        if i in drop or not x:
            continue
        m = x.rstrip()[-1:] in HYPHENS and _HYPHEN.search(x)
        if not m or not _sound(m.group(1)):
            continue
        j, passed = i + 1, False
        while j < len(lines) and (j in drop or not (lines[j] or "").strip()):
            passed |= j in drop
            j += 1
        if j >= len(lines) or j > i + 1 and not passed:
            continue
        n = re.match(r"\s*([^\W\d_]+)", lines[j])
        if n and (n.group(1)[0].islower() or n.group(1)[0].lower() == n.group(1)[0].upper()):
            out.append((i, j, m.group(1), n.group(1), n.group(1).lower() in HANGING))
        elif n and m.group(0).rstrip()[-1] not in "-‐‑":
            out.append((i, j, m.group(1), n.group(1), False))
    return out


def scans(extractions: DataFrame) -> DataFrame:
    """(extr_id, page_starts, text_lines) of the extractions of kind text and ocr, as last delivered."""
    last = extractions.groupBy("extr_id").agg(F.max(F.struct("extracted_at", "kind", "text_lines", "page_starts")).alias("x"))
    return last.where("x.kind in ('text', 'ocr') and size(x.text_lines) > 0").select("extr_id", "x.page_starts", "x.text_lines")


def _forms(text: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text, words with digits and signs inside included; null for a null."""
    return pc.split_pattern_regex(pc.utf8_lower(text), BETWEEN)


def _bare(forms: pa.Array) -> pa.Array:
    return pc.utf8_rtrim(forms, characters="!")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words in the first column, added up in blocks."""
    held: list[pa.Table] = []
    rows = 0

    def block() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])
            t = t.filter(pc.and_(pc.greater(pc.utf8_length(t["word"]), 1), pc.match_substring_regex(t["word"], r"\p{L}")))
            yield from t.combine_chunks().to_batches()

    for batch in batches:
        got = pc.value_counts(pc.utf8_split_whitespace(batch.column(0)).flatten())  # what stands between blanks is taken apart once
        forms = _forms(got.field("values"))
        held.append(pa.table({"word": _bare(forms.flatten()), "n": got.field("counts").take(pc.list_parent_indices(forms))}))
        held[-1] = held[-1].group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).select(["word", "n"])
        rows += len(held[-1])
        if rows > 1_000_000:
            yield from block()
            held, rows = [], 0
    yield from block()


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of all lines of the single string column of ``texts``."""
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_lexicon(extractions: DataFrame, doc_lines: DataFrame) -> DataFrame:
    """:func:`lexicon` of all lines of files and of extractions that can be read, each delivery once."""
    lines, read = once(doc_lines), scans(extractions)
    return lexicon(lines.select("line").unionByName(read.select(F.explode("text_lines").alias("line"))))


def signs(lines: DataFrame, odd: DataFrame, small: int = SMALL) -> DataFrame:
    """(file_id, line_no): lines that may be of a scan; ``odd``: words (low) that a repair is known for.  No query chooses files by them.

    Up to ``small`` such words (counted) go to all tasks, more are met by a join; the rows are the same.
    """
    few = odd.limit(small + 1).count() <= small
    taken = pa.array([r.low for r in odd.collect()] if few else [], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = pc.fill_null(batch.column(2), "")
            length = pc.utf8_length(line)
            wide = pc.or_(pc.match_substring(line, "  "), pc.match_substring(line, "\t"))
            has = lambda pattern, where=None: pc.match_substring_regex(line, pattern) if where is None else pc.and_(where, pc.match_substring_regex(line, pattern))
            mask = pc.or_(pc.or_(has(ENDS), has(MISREAD)), pc.or_(has(NUMBER, pc.less_equal(length, 40)), has(NUMBERED, pc.and_(pc.less_equal(length, HEAD_LINE), wide))))
            mask = mask.to_numpy(zero_copy_only=False).copy()
            if len(taken):
                forms = _forms(line)
                hit = pc.is_in(_bare(forms.flatten()), value_set=taken)
                mask[pc.list_parent_indices(forms).filter(hit).to_numpy(zero_copy_only=False)] = True
            yield batch.select([0, 1]).filter(pa.array(mask))

    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in ("file_id", "line_no"))
    found = lines.mapInArrow(run, kinds)
    if not few:
        words = lines.select("file_id", "line_no", F.explode(F.split(F.lower("line"), r"[^\p{L}\p{M}0-9@|!+$]+")).alias("_w"))
        words = words.select("file_id", "line_no", F.regexp_replace("_w", "!+$", "").alias("low"))
        found = found.unionByName(words.join(odd.select("low"), "low", "left_semi").select("file_id", "line_no")).distinct()
    return found


def documents(read: DataFrame, lines: DataFrame) -> DataFrame:
    """(origin, rec_id, starts, lines) of all that may be a scanned document; lines are (n, line) in order.

    ``read``: :func:`scans`; ``lines``: :func:`once`.  A line without file or number has no place in a document.
    """
    taken = read.select(F.lit("extractions").alias("origin"), F.col("extr_id").alias("rec_id"), F.col("page_starts").alias("starts"), F.transform("text_lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))).alias("lines"))
    files = lines.where("file_id is not null and line_no is not null").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"), "line"))).alias("lines"))
    files = files.select(F.lit("doc_lines").alias("origin"), F.col("file_id").alias("rec_id"), F.lit(None).cast("array<int>").alias("starts"), "lines")
    return taken.unionByName(files)


# words with digits and signs inside, and what is no word though it has letters: editors' asides, addresses, prices
_TOKEN = regex.compile(r"[\p{L}\p{M}0-9@|!+$]*\p{L}[\p{L}\p{M}0-9@|!+$]*")
ASIDE = r"\{[^{}]*\}|(?:https?://|www\.)\S+|\$\s?[0-9][0-9.,]*"
_ASIDE = re.compile(ASIDE)


def _tokens(line: str) -> list[tuple[int, str]]:
    """(position, word) of the words that can be misread."""
    line = _ASIDE.sub(lambda m: " " * len(m.group()), line)
    return [(m.start(), m.group().rstrip("!")) for m in _TOKEN.finditer(line)]


def _words(lines: pa.Array) -> pa.ListArray:
    """The words of :func:`_tokens` for many lines at once."""
    between = pc.utf8_split_whitespace(pc.replace_substring_regex(lines, ASIDE, " "))
    coded = between.flatten().dictionary_encode()  # what stands between blanks is taken apart once
    parts = pc.split_pattern_regex(coded.dictionary, r"[^\p{L}\p{M}0-9@|!+$]+")
    flat = parts.flatten()
    keep = pc.match_substring_regex(flat, r"\p{L}").to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), _bare(flat.filter(pa.array(keep)))).take(coded.indices)
    ends = lists.offsets.to_numpy()[between.offsets.to_numpy() - between.offsets[0].as_py()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten())


def _numbered(numbers: list[int], lines: list[str]) -> tuple[list[int], list[str], list[int]]:
    """Line numbers, lines, and each one's place in ``lines`` (-1 for none); a gap in the numbers is a blank line."""
    if not numbers or numbers[-1] - numbers[0] + 1 == len(numbers):
        return numbers, [x or "" for x in lines], list(range(len(lines)))
    out: tuple[list[int], list[str], list[int]] = ([], [], [])
    for k, (n, line) in enumerate(zip(numbers, lines)):
        gap = [(out[0][-1] + 1, "", -1)] if out[0] and n > out[0][-1] + 1 else []
        for row in (*gap, (n, line or "", k)):
            for c, x in zip(out, row):
                c.append(x)
    return out


def _reads(line: str) -> bool:
    """The line reads as text: most of it are whole words, and most of these aren't mere letters (no junk)."""
    words = line.split()
    whole = [w for w in words if _WORD.match(w)]
    return len(whole) >= 0.6 * len(words) and 2 * sum(len(w) > 2 for w in whole) > len(whole)


def _docs_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(origin, rec_id, starts, line numbers, lines, places of the lines in the batch) of :func:`documents`."""
    items = batch.column(3)
    at = items.offsets.to_numpy() - items.offsets[0].as_py()
    flat = items.flatten()
    numbers, lines = flat.field("n").to_pylist(), flat.field("line").to_pylist()
    for k, (origin, rec, starts) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
        first, end = int(at[k]), int(at[k + 1])
        n, text, place = _numbered(numbers[first:end], lines[first:end])
        yield origin, rec, starts, n, text, [first + p if p >= 0 else -1 for p in place]


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).view("int64") if len(words) else np.zeros(0, "int64")


def _joint(a: Column | np.ndarray, b: Column | np.ndarray) -> Column | np.ndarray:
    """The hash of two neighbouring words, from theirs."""
    return F.shiftleft(a, 1).bitwiseXOR(b) if isinstance(a, Column) else (a << 1) ^ b


_LAYOUT = {
    "origin": pa.string(), "rec_id": pa.int64(), "line_no": pa.int32(), "noise": pa.string(), "word": pa.string(), "place": pa.int32(), "low": pa.string(), "before": pa.string(), "after": pa.string(),
    "proof": pa.bool_(), "h_before": pa.int64(), "h_low": pa.int64(), "h_after": pa.int64(), "pair": pa.int64(), "n": pa.int64(),
}
_LAYOUT_DDL = "origin string, rec_id long, line_no int, noise string, word string, place int, low string, before string, after string, proof boolean, h_before long, h_low long, h_after long, pair long, n long"


def _rows(count: int, **cols: pa.Array) -> pa.RecordBatch:
    """Rows of :data:`_LAYOUT`; what isn't given is null."""
    return pa.RecordBatch.from_arrays([cols.get(c, pa.nulls(count, k)) for c, k in _LAYOUT.items()], names=list(_LAYOUT))


def _laid_out(batch: pa.RecordBatch, taken: pa.Array | None, near: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    # of body lines: the document, line_no, place in the batch, first and last word broken, no furniture that speaks for a scan
    body: tuple[list, ...] = tuple([] for _ in range(6))
    for doc, (origin, rec, starts, numbers, lines, places) in enumerate(_docs_of(batch)):
        drop, told = _furniture(lines, starts)
        found = breaks(lines, drop)
        rows += [(origin, rec, numbers[i], kind, None, told) for i, kind in drop.items()]
        rows += [(origin, rec, numbers[i], "hanging" if hanging else "broken_word", (left + right).lower(), True) for i, _, left, right, hanging in found]
        ends = {i for i, *_ in found}
        begins = {j for _, j, *_ in found}
        own = [i for i, x in enumerate(lines) if x and i not in drop]
        body[0].extend([doc] * len(own))
        body[1].extend([numbers[i] for i in own])
        body[2].extend([places[i] for i in own])
        body[3].extend([i in begins for i in own] if begins else [False] * len(own))
        body[4].extend([i in ends for i in own] if ends else [False] * len(own))
        body[5].extend([not (drop and told)] * len(own))
    kinds = ("origin", "rec_id", "line_no", "noise", "word", "proof")
    yield _rows(len(rows), **{k: pa.array([x[j] for x in rows], _LAYOUT[k]) for j, k in enumerate(kinds)})
    texts = batch.column(3).flatten().field("line").take(pa.array(body[2], pa.int64()))
    lists = _words(texts)
    words, first = lists.flatten(), lists.offsets.to_numpy()
    if not len(words):
        return
    sizes = np.diff(first)
    of = np.repeat(np.arange(len(sizes)), sizes)  # the line of each word
    coded = pc.utf8_lower(words).dictionary_encode()
    forms, code = coded.dictionary, coded.indices.to_numpy()
    hashes = _hashes(forms)
    # neighbouring pairs, of words that are asked for or that these may stand for
    together = of[:-1] == of[1:]
    if near is not None:
        wanted = np.isin(hashes, near)[code]
        together &= wanted[:-1] | wanted[1:]
    pairs, n = np.unique(_joint(hashes[code[:-1]], hashes[code[1:]])[together], return_counts=True)
    yield _rows(len(pairs), noise=pa.array(["pair"] * len(pairs), pa.string()), pair=pa.array(pairs), n=pa.array(n.astype("int64")))
    asked = np.ones(len(forms), bool) if taken is None else pc.is_in(forms, value_set=taken).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(asked[code])
    place = at - first[of[at]]
    whole = (place >= np.asarray(body[3], int)[of[at]]) & (place < (sizes - np.asarray(body[4], int))[of[at]])
    at, place = at[whole], place[whole]
    line = pa.array(of[at])
    doc = pa.array(body[0], pa.int64()).take(line)
    proof = np.zeros(len(sizes), bool)
    for k in np.unique(of[at]).tolist():
        proof[k] = body[5][k] and _reads(texts[k].as_py())

    def side(k: int) -> tuple[pa.Array, pa.Array]:
        there = (place + k >= 0) & (place + k < sizes[of[at]])
        other = code[np.where(there, at + k, 0)]
        return pc.if_else(pa.array(there), forms.take(pa.array(other)), ""), pa.array(np.where(there, hashes[other], 0))

    before, after = side(-1), side(1)
    yield _rows(
        len(at), origin=batch.column(0).take(doc), rec_id=batch.column(1).take(doc), line_no=pa.array(body[1], pa.int32()).take(line), noise=pa.array(["asked"] * len(at), pa.string()),
        word=words.take(pa.array(at)), place=pa.array(place.astype("int32")), low=forms.take(pa.array(code[at])), before=before[0], after=after[0], proof=pa.array(proof).take(line),
        h_before=before[1], h_low=pa.array(hashes[code[at]]), h_after=after[1],
    )


def layout(docs: DataFrame, fix: DataFrame, small: int = SMALL) -> DataFrame:
    """What each document holds, by ``noise``: its furniture; broken_word and hanging with the joined ``word``; asked:
    the whole words of body lines that ``fix`` (:func:`repairs`) has, with their place among the line's words and their
    neighbours; pair: how often two words stand together, in a block of documents, by hash.  ``proof``: the furniture, or a
    misread word in the line, as it reads as text, speaks for a scan (the latter only told of documents whose furniture doesn't).

    Up to ``small`` forms (counted) go to all tasks; where there are more, all words are put out and meet them by a join.
    """
    lows = fix.select("low", "h_low").distinct()
    few = lows.limit(small + 1).count() <= small
    taken = pa.array([r.low for r in lows.collect()], pa.string()) if few else None
    near = fix.select(F.explode(F.array("h_low", "h_right")).alias("h")).distinct() if few else None
    near = np.array([r.h for r in near.collect()], "int64") if few else None  # at most two a form and candidate
    got = docs.mapInArrow(lambda batches: (x for b in batches for x in _laid_out(b, taken, near)), _LAYOUT_DDL)
    if few:
        return got
    others = got.where("noise <> 'asked'")
    return others.unionByName(got.where("noise = 'asked'").join(lows.select("low"), "low", "left_semi").select(*others.columns))


# --- symmetric-delete index ------------------------------------------------------------


def _deletes(word: Column, chars: str) -> Column:
    """What is left of the word when one of ``chars`` in it is deleted."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.contains(F.lit(chars), F.substring(word, i, F.lit(1))))
    return F.array_distinct(F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("\x1f"), F.substring(word, i + 1, F.length(word)))))


# Pairs of letters that are misread as one letter, and that one letter is misread as.
_MERGED = (("rn", "m"), ("li", "h"), ("ii", "u"), ("ii", "ü"), ("vv", "w"), ("cl", "d"), ("lc", "k"))
_READ_AS_ONE: dict[str, str] = {}
for _pair, _one in _MERGED:
    _READ_AS_ONE[_pair] = _READ_AS_ONE.get(_pair, "") + _one


def _unmerged(word: Column) -> Column:
    """Readings of ``word`` in which one pair of characters is taken for the single one it may stand for."""

    def readings(pair: str, one: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)) == F.lit(pair))
        return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(one), F.substring(word, i + 2, F.length(word))))

    options = F.flatten(F.array(*[readings(pair, one) for pair, one in _MERGED]))
    return F.when(F.length(word) > 1, options).otherwise(F.array().cast("array<string>"))


def _expanded(word: Column) -> Column:
    """Readings of ``word`` in which one character is taken for the pair that it may stand for."""

    def readings(pair: str, one: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.lit(1)) == F.lit(one))
        return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit(pair), F.substring(word, i + 1, F.length(word))))

    return F.flatten(F.array(*[readings(pair, one) for pair, one in _MERGED]))


def distance(wrong: str, right: str) -> float:
    """Weighted edit distance: a confusion of the table costs 0.4 (the first listed, and two letters read as one, 0.3), another edit 1."""
    i, n = 0, min(len(wrong), len(right))
    while i < n and wrong[i] == right[i]:
        i += 1
    k = 0
    while k < n - i and wrong[-1 - k] == right[-1 - k]:
        k += 1
    return _weighed(wrong[i : len(wrong) - k], right[i : len(right) - k])


@lru_cache(65536)
def _weighed(w: str, r: str) -> float:
    """:func:`distance` of the parts that differ."""
    big = 9.0
    d = [[big] * (len(r) + 1) for _ in range(len(w) + 1)]
    d[0][0] = 0.0
    for i in range(len(w) + 1):
        for j in range(len(r) + 1):
            here = d[i][j]
            if here >= big:
                continue
            if i < len(w) and j < len(r):
                same = w[i] == r[j]
                for k, x in enumerate(CONFUSED.get(r[j], ())):
                    if w.startswith(x, i):
                        at = d[i + len(x)]
                        at[j + 1] = min(at[j + 1], here + (0.3 if k == 0 else 0.4))
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (0.0 if same else 1.0))
                if w[i] in _READ_AS_ONE.get(r[j : j + 2], ""):
                    d[i + 1][j + 2] = min(d[i + 1][j + 2], here + 0.3)
            if i < len(w):
                d[i + 1][j] = min(d[i + 1][j], here + 1.0)
            if j < len(r):
                d[i][j + 1] = min(d[i][j + 1], here + 1.0)
    return d[len(w)][len(r)]


# single characters that are misread as another one, and what they are misread as: no other delete can lead to a repair
_RIGHT = "".join(sorted(r for r, wrong in CONFUSED.items() if any(len(x) == 1 for x in wrong)))
_WRONG = "".join(sorted({x for wrong in CONFUSED.values() for x in wrong if len(x) == 1}))


def _as_letters(word: Column) -> Column:
    """Readings of an odd form with all its digits and signs taken for letters: for the first, and for the last, that each may stand for."""
    signs_ = "".join(INTRUDERS)
    return F.array(*[F.translate(word, signs_, "".join(x[k] for x in INTRUDERS.values())) for k in (0, -1)])


def candidates(suspects: DataFrame, known: DataFrame) -> DataFrame:
    """(word, right, n_right, cost, h_low, h_right) for each of ``suspects`` (word), from ``known`` (word, n), through shared
    deletes and through readings of whole letters; the last two are the words' hashes.
    """
    word = F.col("word")
    index = known.select(word.alias("right"), F.col("n").alias("n_right"), F.explode(F.concat(F.array(word), _deletes(word, _RIGHT))).alias("_d"))
    asked = suspects.select("word", F.explode(F.array_distinct(F.concat(_deletes(word, _WRONG), _unmerged(word), _expanded(word), _as_letters(word)))).alias("_d"))
    met = asked.join(index, "_d").where("word <> right").select("word", "right", "n_right").distinct()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = [distance(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            cols = [*batch.columns, pa.array(cost, pa.float64()), *(pa.array(_hashes(batch.column(i))) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "cost", "h_low", "h_right"])

    # each sign of an odd form may be a misread letter
    most = F.greatest(F.lit(COST), F.lit(SIGN) * F.regexp_count("word", F.lit("[0-9@|!+$]")) + F.lit(1e-9))
    return met.mapInArrow(weigh, "word string, right string, n_right long, cost double, h_low long, h_right long").where(F.col("cost") <= most)


def repairs(counts: DataFrame) -> DataFrame:
    """(low, n, right, cost, n_right, odd, sure, h_low, h_right): forms of the lexicon ``counts`` that may be misread, and all they may stand for.

    ``odd``: with a digit or sign inside, no word.  ``sure``: odd, or rare against one of what it may
    stand for; a word of up to three letters that would grow is never rare.  A word that is itself rare
    against the form stands for nothing: it is the misread one.
    """
    known = counts.where((F.col("n") >= KNOWN) & ~F.col("word").rlike("[0-9@|!+$]"))
    odd = F.col("word").rlike("[0-9@|!+$]")
    met = candidates(counts.select("word"), known).join(counts, "word").where(odd | (F.col("n") < RARER * F.col("n_right")))
    rare = F.max(F.when((F.length("word") > 3) | (F.length("right") <= F.length("word")), F.col("n_right")))
    all_of = met.groupBy("word", "n", "h_low").agg(F.collect_list(F.struct("right", "cost", "n_right", "h_right")).alias("b"), rare.alias("top"))
    kinds = all_of.select(F.col("word").alias("low"), "n", "h_low", odd.alias("odd"), (odd | (F.coalesce("top", F.lit(-1)) >= RARER * F.col("n"))).alias("sure"), F.explode("b").alias("b"))
    return kinds.select("low", "n", "b.right", "b.cost", "b.n_right", "odd", "sure", "h_low", "b.h_right")


def in_context(docs: DataFrame, asked: DataFrame, choices: DataFrame) -> DataFrame:
    """Of the words ``asked`` with their repairs to choose from (:func:`repairs`), what they stand for in their place.

    The neighbouring pairs, all other occurrences counted, must not speak for the word as it is:

    * an odd form is always misread;
    * a form that is rare against what it may stand for stays if more pairs hold it than hold that;
      where no pair tells, it stays if it is itself a word of the lexicon and not very rare;
    * another word is misread only where, on either side, the pair with what it stands for is
      ``RARER`` times as frequent as the pair with the word.

    Of what is left, the neighbouring pairs and the weighted distance pick one, and the more frequent
    word only where these are equal.
    """
    words = ["before", "low", "after"]
    kinds = asked.groupBy(*words).agg(F.count(F.lit(1)).alias("k"), *[F.first(f"h_{c}").alias(f"h_{c}") for c in words]).join(if_small(choices.drop("h_low"), SMALL), "low")
    col = F.col
    sides = {"n1": _joint(col("h_before"), col("h_low")), "n2": _joint(col("h_before"), col("h_right")), "n3": _joint(col("h_low"), col("h_after")), "n4": _joint(col("h_right"), col("h_after"))}
    kinds = cut(kinds.withColumns({f"h{c}": h for c, h in sides.items()}))
    wanted = kinds.select(F.explode(F.array(*[f"h{c}" for c in sides])).alias("pair")).distinct()
    counted = docs.where("noise = 'pair'").select("pair", "n").join(if_small(cut(wanted), PAIRS), "pair", "left_semi").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    for c in sides:
        kinds = kinds.join(if_small(counted, PAIRS).select(col("pair").alias(f"h{c}"), col("n").alias(c)), f"h{c}", "left")
    kinds = kinds.na.fill(0, [*sides])
    own = F.col("n1") - F.when(F.col("before") == "", 0).otherwise(F.least("k", "n1")) + F.col("n3") - F.when(F.col("after") == "", 0).otherwise(F.least("k", "n3"))
    other = F.col("n2") + F.col("n4")
    silent = (F.col("n") < KNOWN) | (F.col("n_right") >= RARER * RARER * F.col("n"))
    rare = (other > own) | ((other == own) & silent)
    told = kinds.where(F.when(F.col("odd"), F.lit(True)).when(F.col("sure"), rare).otherwise((F.col("n2") > RARER * F.col("n1")) & (F.col("n4") > RARER * F.col("n3"))))
    seen = lambda n, side: F.when(F.col(side) == "", F.lit(0.0)).otherwise(F.log1p(n))  # noqa: E731 - the line's end tells nothing
    score = F.round(seen("n2", "before") + seen("n4", "after") - WEIGHT * F.col("cost"), 6)
    told = told.groupBy("before", "low", "after").agg(F.max_by("right", F.struct(score, "n_right", "right")).alias("right"))
    return asked.join(told, ["before", "low", "after"]).select("origin", "rec_id", "line_no", "place", "word", "right", "proof")


def found(extractions: DataFrame, doc_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, repairs): rows (origin, rec_id, line_no, noise) and (origin, rec_id, line_no, place, word, right)."""
    return read_scans(extractions, doc_lines)[:2]


def read_scans(extractions: DataFrame, doc_lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cases, repairs, sources, docs): rows (origin, rec_id, line_no, noise), rows (origin, rec_id, line_no, place, word,
    right), the scanned documents as :func:`documents` has them, and the :func:`layout` of all documents.
    """
    lines, read = cut(once(doc_lines)), scans(extractions)
    counts = cut(lexicon(lines.select("line").unionByName(read.select(F.explode("text_lines").alias("line")))))
    fix = cut(repairs(counts))
    docs = cut(layout(documents(read, lines), fix))
    asked = docs.where("noise = 'asked'").where((F.length("word") > 2) | ((F.length("word") == 2) & F.col("word").rlike("\\p{Ll}")))
    read_as = cut(in_context(docs, asked, fix))
    hanging = docs.where("noise = 'hanging'").select("origin", "rec_id", "line_no", "word").join(counts.where(F.col("n") >= KNOWN), "word", "left_semi")
    cases = docs.where("noise in ('broken_word', 'running_head', 'page_number')").select("origin", "rec_id", "line_no", "noise", "proof")
    cases = cases.unionByName(hanging.select("origin", "rec_id", "line_no", F.lit("broken_word").alias("noise"), F.lit(True).alias("proof")))
    cases = cases.unionByName(read_as.select("origin", "rec_id", "line_no", F.lit("misread").alias("noise"), "proof"))
    # a file is a scan by its furniture or by two lines of text with broken or misread words
    words = F.col("noise").isin("broken_word", "misread")
    proof = cases.where("origin = 'doc_lines'").groupBy("rec_id").agg(F.countDistinct(F.when(words & F.col("proof"), F.col("line_no"))).alias("_w"), F.max((~words & F.col("proof")).cast("int")).alias("_f"))
    proof = cut(proof.select("rec_id", ((F.col("_f") == 1) | (F.col("_w") >= 2)).alias("scan")))
    stray = if_small(proof.where("not scan").select(F.lit("doc_lines").alias("origin"), "rec_id"), SMALL)
    cases, read_as = cases.drop("proof").distinct(), read_as.drop("proof")
    sources = documents(read, lines.join(if_small(proof.where("scan").select(F.col("rec_id").alias("file_id")), SMALL), "file_id", "left_semi"))
    return *(df.join(stray, ["origin", "rec_id"], "left_anti") for df in (cases, read_as)), sources, docs


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for (origin, rec, _, numbers, lines, _), fixes, marks in zip(_docs_of(batch), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            at = {n: i for i, n in enumerate(numbers)}
            drop = {at[x["line_no"]] for x in marks or [] if not x["broken"]}
            joins = {at[x["line_no"]] for x in marks or [] if x["broken"]}  # lines whose last word goes on
            by_line: dict[int, dict[int, str]] = {}
            for x in fixes or []:
                by_line.setdefault(x["line_no"], {})[x["place"]] = x["right"]
            parts, current, indent = [], "", None
            base = 0
            for i, x in enumerate(lines):
                if i not in drop and x.strip():
                    base = min(base or len(x), len(x) - len(x.lstrip()))
                    if not base:
                        break
            open_word = False
            for i, x in enumerate(lines):
                if i in drop:
                    continue
                if numbers[i] in by_line:
                    for place, (at, word) in reversed(list(enumerate(_tokens(x)))):
                        if right := by_line[numbers[i]].get(place):
                            new = right.upper() if word.isupper() and len(word) > 1 else right.capitalize() if word[:1].isupper() else right
                            x = x[:at] + new + x[at + len(word) :]
                bare = x.strip()
                if not bare:
                    if current and not open_word:
                        after_furniture = any(k in drop for k in range(max(0, i - 3), min(len(lines), i + 4)))
                        if not (after_furniture and not re.search(r"[.!?…][”’\"»')]*\s*$", current)):
                            parts.append(current)
                            current = ""
                    continue
                if current and not open_word and x[0] != bare[0] and len(x) - len(x.lstrip()) >= base + 2:
                    parts.append(current)
                    current = ""
                current = current + bare if open_word or not current else current + " " + bare
                open_word = i in joins
                if open_word:
                    current = re.sub(r"[-‐‑¬­⸗]\s*$", "", current)
            if current:
                parts.append(current)
            rows += [(origin, rec, k, t) for k, t in enumerate(parts, 1)]
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int32(), pa.string()])], names=["origin", "rec_id", "para_no", "text"])


def paragraphs(extractions: DataFrame, doc_lines: DataFrame) -> DataFrame:
    """(origin, rec_id, para_no, text): the repaired running text of documents with signs of a scan.

    Furniture is left out, broken words are joined (compounds lose the hyphen only if it was
    the line's own), misread words are replaced by what they stand for.
    """
    _, fix, sources, docs = read_scans(extractions, doc_lines)
    per_doc = fix.groupBy("origin", "rec_id").agg(F.collect_list(F.struct("line_no", "place", "right")).alias("fixes"))
    marks = docs.where("noise in ('broken_word', 'running_head', 'page_number')").groupBy("origin", "rec_id").agg(F.collect_list(F.struct("line_no", (F.col("noise") == "broken_word").alias("broken"))).alias("marks"))
    docs = sources.join(per_doc, ["origin", "rec_id"], "left").join(marks, ["origin", "rec_id"], "left").select("origin", "rec_id", "starts", "lines", "fixes", "marks")
    return docs.mapInArrow(_paragraphs, "origin string, rec_id long, para_no int, text string")
