"""One form for text that prints alike: widths, accents, blanks, invisible characters, look-alike letters.

Method: the look-alike relation over strings and code points that occur in the corpus is
closed transitively by union-find; each class is represented by its member that is most
frequent in the corpus; lines are rewritten greedily, longest match first, by one
multi-pattern automaton (accents are first parted from their letters, so that composed
and combining forms meet).  Two lines print alike exactly if their forms are equal.

Defined results: null lines have a null form; blanks at the end of a line don't print and
go; indentation, case, accents, punctuation and the number of inner blanks are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Letters of other scripts that print like Latin ones.
LOOKALIKE = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "S": "ЅՏ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "Ζ",
    "-": "‐‑",
}
# Ranges of characters that print nothing, and of blanks.
INVISIBLE = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x2069), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
BLANK = ((0x09, 0x09), (0x0B, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# Compatibility forms that print as what they stand for: radicals, ligatures, widths.
SAME_PRINT = ((0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0xFF00, 0xFFEF))

SHORTEST = 20  # characters a line must have to be paired
SPLIT = 1000  # lines of one spelling that are paired in one task


def _within(c: int, ranges: tuple) -> bool:
    return any(a <= c <= b for a, b in ranges)


def related(c: str) -> list[str]:
    """Strings that print like the code point ``c``."""
    n, out = ord(c), []
    if _within(n, INVISIBLE):
        out.append("")
    if _within(n, BLANK):
        out.append(" ")
    if _within(n, SAME_PRINT):
        plain = unicodedata.normalize("NFKD", c)
        if plain != c:
            out.append(plain)
    out += [latin for latin, others in LOOKALIKE.items() if c in others]
    return out


class Classes:
    """Transitive look-alike classes over the characters of a corpus, by union-find."""

    def __init__(self, counts: dict[str, int]):
        self.up: dict[str, str] = {}
        self.counts = counts
        for c in sorted(counts):
            for other in related(c):
                self._join(c, other)
        groups: dict[str, list[str]] = {}
        for s in self.up:
            groups.setdefault(self._top(s), []).append(s)
        self.form: dict[str, str] = {}
        for members in groups.values():
            best = min(members, key=lambda s: (-self._weight(s), len(s), s))
            self.form.update({s: best for s in members if s != best and s})
        for s in self.form:  # what a string stands for may itself hold characters with a form
            self.form[s] = self._settled(self.form[s])

    def _weight(self, s: str) -> float:
        return float("inf") if not s else min(self.counts.get(c, 0) for c in s)

    def _settled(self, s: str) -> str:
        for _ in range(4):
            new = "".join(self.form.get(c, c) for c in s)
            if new == s:
                break
            s = new
        return s

    def _top(self, s: str) -> str:
        self.up.setdefault(s, s)
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def _join(self, a: str, b: str) -> None:
        a, b = self._top(a), self._top(b)
        if a != b:
            self.up[a] = b


class Rewriter:
    """Greedy leftmost-longest rewriting by one automaton of all patterns."""

    def __init__(self, form: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, to in form.items():
            self.automaton.add_word(pattern, (len(pattern), to))
        if form:
            self.automaton.make_automaton()
        self.any = bool(form)

    def __call__(self, text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        if not self.any:
            return text
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - n])
            out.append(to)
            at = end + 1
        out.append(text[at:])
        return "".join(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        text = unicodedata.normalize("NFD", "".join(t for t in batch.column(0).to_pylist() if t))
        if text:
            total += np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"c": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})


def fit(texts: DataFrame) -> dict[str, str]:
    """Pattern -> form over all of the single string column of ``texts``.

    The counts that come to the driver are bounded by the number of code points.
    """
    got = texts.mapInArrow(_count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    return Classes({chr(c): n for c, n in zip(got.column("c").to_pylist(), got.column("n").to_pylist())}).form


def _plain(line: Column, form: dict[str, str]) -> Column:
    """Lines of ASCII characters that are their own form: no Python is needed for them."""
    odd = "".join(f"\\x{ord(c):02x}" for c in form if len(c) == 1 and c < "\x7f")
    return ~line.rlike(f"[^\\x20-\\x7e]|[{odd}]" if odd else "[^\\x20-\\x7e]")


def canonical(lines: DataFrame, line: str, keep: list[str], form: dict[str, str] | None = None) -> DataFrame:
    """``keep``, the line as ``line`` and its form as ``canonical`` (null for null)."""
    form = fit(lines.select(line)) if form is None else form
    table = lines.select(*keep, F.col(line).alias("line"))
    plain = _plain(F.col("line"), form)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = Rewriter(form)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            # lines hold no NUL of their own that matters: it parts them for one pass over all
            whole = apply("\0".join(t.replace("\0", "�") for t in texts))
            new = [t.rstrip(" ") for t in whole.split("\0")] if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*batch.schema.names, "canonical"])

    fields = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in [*keep, "line"])
    python = table.where(F.col("line").isNotNull() & ~plain).mapInArrow(rewrite, f"{fields}, canonical string")
    return python.unionByName(table.where(F.col("line").isNull() | plain).withColumn("canonical", F.rtrim("line")))


def _members(lines: DataFrame, form: dict[str, str] | None, shortest: int) -> tuple[DataFrame, DataFrame]:
    """(members, spellings) of the classes of lines that print alike in more than one spelling.

    members: class (k1, k2), spelling (h), file_id, line_no; spellings: class, spelling, n, first (file_id, line_no).
    A class can only hold a pair if some line of it is not written in its form, so only such classes are looked at.
    """
    form = fit(lines.select("line")) if form is None else form
    whole = lines.select("file_id", "line_no", "line").where(F.length("line") >= shortest)
    got = canonical(whole, "line", ["file_id", "line_no"], form).where(F.length("canonical") >= shortest)
    keyed = got.select(
        "file_id", "line_no", F.xxhash64("canonical").alias("k1"), F.xxhash64(F.lit(1), "canonical").alias("k2"),
        F.xxhash64("line").alias("h"), (F.col("line") != F.col("canonical")).alias("changed"),
    )
    keyed = cut(keyed)
    changed = keyed.where("changed").select("k1", "k2").distinct()
    several = keyed.join(changed, ["k1", "k2"], "left_semi").groupBy("k1", "k2", "h").agg(F.count(F.lit(1)).alias("_n"))
    mixed = several.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_v")).where("_v > 1").select("k1", "k2")
    members = cut(keyed.join(mixed, ["k1", "k2"]).select("k1", "k2", "h", "file_id", "line_no").distinct())
    spellings = members.groupBy("k1", "k2", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_id", "line_no")).alias("first"))
    return members, spellings


def classes(lines: DataFrame, form: dict[str, str] | None = None, shortest: int = SHORTEST) -> DataFrame:
    """(class_id, spelling, lines, file_id, line_no): one row per spelling of each class of lines that print
    alike, how many lines are spelled so, and the first of them; copies are counted, not listed.
    """
    spellings = _members(lines, form, shortest)[1]
    return spellings.select(F.col("k1").alias("class_id"), F.col("h").alias("spelling"), F.col("n").alias("lines"), "first.file_id", "first.line_no")


def pairs(lines: DataFrame, form: dict[str, str] | None = None, shortest: int = SHORTEST, split: int = SPLIT) -> DataFrame:
    """Pairs of (file_id, line_no) whose lines print alike but differ; smaller key first.

    Different spellings of a class are paired first (there are few), then spread over their lines: copies
    are never compared.  The lines of a spelling are dealt to parts of about ``split``, and each part of
    one meets each part of the other, so that no task holds a frequent spelling whole.
    """
    members, spellings = _members(lines, form, shortest)
    spellings = spellings.withColumn("parts", F.ceil(F.col("n") / split).cast("int")).drop("first", "n")
    parted = members.join(spellings, ["k1", "k2", "h"]).withColumn("part", F.pmod(F.xxhash64("file_id", "line_no"), F.col("parts")).cast("int"))
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}.parts") - 1))
    two = spellings.alias("a").join(spellings.alias("b"), ["k1", "k2"]).where("a.h < b.h")
    two = two.select("k1", "k2", F.col("a.h").alias("ha"), F.col("b.h").alias("hb"), F.col("b.parts").alias("_pb"), every("a").alias("pa"))
    two = two.select("k1", "k2", "ha", "hb", "pa", F.explode(F.sequence(F.lit(0), F.col("_pb") - 1)).alias("pb"))
    one = parted.select("k1", "k2", F.col("h").alias("ha"), F.col("part").alias("pa"), F.struct("file_id", "line_no").alias("x"))
    other = parted.select("k1", "k2", F.col("h").alias("hb"), F.col("part").alias("pb"), F.struct("file_id", "line_no").alias("y"))
    both = two.join(one, ["k1", "k2", "ha", "pa"]).join(other, ["k1", "k2", "hb", "pb"])
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return both.where("x <> y").select(
        low["file_id"].alias("file_id_1"), low["line_no"].alias("line_no_1"), high["file_id"].alias("file_id_2"), high["line_no"].alias("line_no_2")
    ).distinct()
