"""Scalar text functions as column expressions (JVM-side throughout, but for NFC).

Regular-expression classes follow Unicode, not ASCII: letters of a word are
``[\\p{L}\\p{Nl}\\p{No}]`` (word characters without digits and the underscore).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTER = r"\p{L}\p{Nl}\p{No}"
BLANK = r"\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # the same, one by one
WORD = rf"[{LETTER}]+(?:['’][{LETTER}]+)*"
# Letters that digits are misread as, and the digits.
LOOKALIKES, DIGITS = "lI|iOoDSsBZ", "11110005582"
MAX_PAGE_NUMBER = 6


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def nfc(text: Column) -> Column:
    """Composed form; only texts with combining marks go through Python."""
    return F.when(text.rlike(r"\p{M}"), _nfc(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Without the blanks (of any kind) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column, compose: bool = True) -> Column:
    """Word tokens: letter runs with inner apostrophes, counted on the composed form."""
    return F.regexp_extract_all(nfc(text) if compose else text, F.lit(WORD), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(words(text))


def type_count(text: Column) -> Column:
    """Distinct words, letter case aside."""
    return F.size(F.array_distinct(F.transform(words(text), F.lower)))


def line_key(line: Column) -> Column:
    """What makes two running heads comparable: no digits, no punctuation, single blanks, lower case."""
    out = F.regexp_replace(line, r"\p{Nd}+", " ")
    out = F.regexp_replace(out, rf"[^{LETTER}\p{{M}}\p{{Nd}}_{BLANK}]", " ")
    return F.lower(strip(F.regexp_replace(out, f"[{BLANK}]+", " ")))


def _bare(line: Column) -> Column:
    return strip(F.regexp_replace(line, rf"[^{LETTER}\p{{M}}\p{{Nd}}_{BLANK}]", ""))


def page_number(line: Column) -> Column:
    """The page number a line holds, misread digits allowed; null if it holds none.

    One character must be a digit; else at least half of at most six must be digits already,
    and all must be digits once look-alikes are read as such.
    """
    s = _bare(line)
    real = F.regexp_count(s, F.lit("[0-9]"))
    read = F.translate(s, LOOKALIKES, DIGITS)
    good = (F.length(s) >= 1) & (F.length(s) <= MAX_PAGE_NUMBER) & (real * 2 >= F.length(s)) & read.rlike("^[0-9]+$") & ((F.length(s) > 1) | s.rlike("^[0-9]$"))
    return F.when(good, read.try_cast("int"))


def folded_words(text: Column) -> Column:
    """Lower-cased words with the long s folded and punctuation dropped."""
    clean = F.regexp_replace(F.translate(text, "ſ", "s"), rf"[^{LETTER}\p{{M}}\p{{Nd}}_{BLANK}]", " ")
    return F.filter(F.split(F.lower(strip(clean)), f"[{BLANK}]+"), lambda w: w != "")


def is_upper(line: Column) -> Column:
    """It has letters, and all are capitals."""
    return line.rlike(r"[\p{L}]") & ~line.rlike(r"[\p{L}&&[^\p{IsUppercase}]]")


def letter_ratio(text: Column) -> Column:
    """Letters among characters; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(f"[{LETTER}]")) / F.length(text)).otherwise(F.lit(0.0))


def roman_value(text: Column) -> Column:
    """Value of a roman numeral (subtractive), folded from the right; null if it is none."""
    value = F.create_map(*[x for c, v in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)) for x in (F.lit(c), F.lit(v))])
    digits = F.split(F.reverse(F.upper(text)), "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))
    fold = F.aggregate(
        F.filter(digits, lambda c: c != ""), start,
        lambda a, c: F.struct((a["total"] + F.when(value[c] < a["most"], -value[c]).otherwise(value[c])).alias("total"), F.greatest(a["most"], value[c]).alias("most")),
        lambda a: a["total"],
    )
    return F.when(text.rlike("(?i)^[IVXLCDM]+$"), fold)


def numeral_value(text: Column) -> Column:
    """A number in digits or roman numerals, a dot after it allowed."""
    bare = F.regexp_replace(strip(text), r"\.+$", "")
    return F.coalesce(F.when(bare.rlike("^[0-9]{1,9}$"), bare.try_cast("int")), roman_value(bare))


def phrase_score(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur, letter case aside."""
    low = F.lower(text)
    return F.size(F.filter(F.array([F.lit(p) for p in phrases]), lambda p: F.contains(low, p)))


def control_key(line: Column) -> Column:
    """An interface label's family: digits as #, edges without punctuation."""
    s = F.regexp_replace(F.lower(strip(line)), r"\p{Nd}+", "#")
    return F.regexp_replace(s, rf"^[^{LETTER}\p{{M}}\p{{Nd}}_]+|[^{LETTER}\p{{M}}\p{{Nd}}_]+$", "")


def label_shaped(line: Column) -> Column:
    """Short enough and of few enough words to be a control."""
    s = strip(line)
    return (s != "") & (F.length(s) <= 24) & (F.size(F.split(s, f"[{BLANK}]+")) <= 4)


# The shapes of a handle (bare, or a link that shows it) and of a relative time (a number and a unit).
HANDLE = r"^(?:@[\w.]+|\[@?[\w.]+\]\(\S+\))$"
TIME_UNITS = "smhdwy"


def is_handle(line: Column) -> Column:
    return strip(line).rlike(HANDLE)


def is_relative_time(line: Column) -> Column:
    return strip(line).rlike(rf"(?i)^\[?\s*[0-9]{{1,3}}\s*[{TIME_UNITS}]\s*\]?(?:\(\S+\))?$")


def note_label(label: Column) -> Column:
    """A footnote label in one form: lower case, no leading zeros."""
    bare = F.regexp_replace(F.lower(strip(label)), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def strip_notes(line: Column, labels: Column) -> Column:
    """``line`` without the bracketed labels that are in ``labels`` (an array of note labels)."""
    parts = F.regexp_extract_all(line, F.lit(r"\[[A-Za-z0-9#]{1,7}\]|\{[A-Za-z0-9#]{1,7}\}"), F.lit(0))
    own = F.filter(parts, lambda p: F.array_contains(labels, note_label(F.substring(p, F.lit(2), F.length(p) - 2))))
    return F.aggregate(F.array_distinct(own), line, lambda a, p: F.replace(a, p, F.lit("")))


def join_wrapped(lines: Column) -> Column:
    """Wrapped lines (array) as one: a blank between them, none after a hyphen that is part of a word."""
    trimmed = F.transform(lines, strip)
    glued = F.array_join(trimmed, "\x1f")
    glued = F.regexp_replace(glued, rf"([{LETTER}][{LETTER}\p{{M}}\p{{Nd}}_'’]*-)\x1f", "$1")
    return F.regexp_replace(F.regexp_replace(glued, "\x1f", " "), "[ \t]+", " ")
