"""Sentences and other units of texts in many languages and scripts, in SQL expressions.

Method: dots that end nothing (decimals, addresses, initials, abbreviations, ordinals) and
marks inside speech that goes on with its speaker are masked with private-use characters,
one for one, so that positions stay; unit ends are then marked by script-specific
terminator patterns, the text is split there, and the original characters are cut out
by position.  No Python runs; every step is a column expression.

Where blank lines part the paragraphs, a single line break may lie within a sentence;
elsewhere every line break ends a unit.

Defined results: null, empty and blank texts have no units; a text without any terminator
is one unit per line or paragraph; positions count code points from 0; the same
(key, text) given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOT, SPEECH, BREAK, GAP = "", "", "", ""

# Abbreviations that a name or more of the sentence always follows.
TITLES = (
    "Dr Mr Mrs Ms Prof Capt St Gen Col Lt Sgt Rev Hon Messrs Mt Sr Sra Srta Dra Dña Mme Mlle MM Mgr Frl geb z d т г гг ул проф акад им тов д-р гр κ κα κκ δρ καθ "
    "डॉ प्रो श्री د أ ดร ศ นาย Co cf vs bzw ca approx dept av p pp pág págs e.g i.e z.B d.h u.a i.d.R p.ej p.ex c.-à-d т.е т.к"
).split()
# Abbreviations that go on if a number follows.
NUMBERED = "No Nos Nr núm fig figs Fig Abb vol Vol Bd S c ca est lb oz n стр рис гл табл № σελ εικ ch art sec Sec ed Kap Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
# Nouns whose letter is a label and no initial, and words that open a sentence after a single letter.
LABELLED = "Plan|[Vv]itamin|[Ss]ection|Type|Class|Group|Table|Exhibit|Option|Appendix|Grade|Gate|Block|Abschnitt|Klasse|Gruppe|Anhang|groupe|classe|annexe|grupo|clase|anexo"
OPENERS = "Then|It|He|She|The|They|We|But|This|That|There|You|When|Er|Sie|Es|Der|Die|Das|Dann|Wir|Il|Elle|Ils|Elles|Puis|Ella|Ellos|Luego|Он|Она|Они|Это"
# Months that follow an ordinal number with a dot.
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jh"
# Verbs that tie speech to its speaker, where letter case does not show it.
SAID = "said|asked|shouted|cried|called|replied|answered|whispered|added|murmured|muttered|exclaimed|demanded|yelled|wondered|remarked|told|wrote"
SAID_ZH = "说|问|说道|问道|喊道|喊|叫|叫道|答|答道|写道"
SAID_HI = "पूछा|कहा|बोला|बोली|चिल्लाया|चिल्लाई|पुकारा|सोचा"
SAID_AR = "سأل|قال|صاح|هتف|أجاب|سألت|قالت|صاحت|ردت|رد|همس"
SAID_TH = "ถาม|กล่าว|พูด|ตะโกน|บอก|ตอบ|ร้อง"

_END = ".!?…‼⁇⁈⁉"
_WIDE = "。！？｡"
_OWN = "।॥؟۔"
_CLOSE = "”“»\"'’)\\]」』）›"
_SHUT = "”»\"'’)\\]」』）›"  # without the mark that opens speech in Chinese
_ANY = f"{_END}{_WIDE}{_OWN};"


def _alternatives(words: list[str]) -> str:
    return "|".join(sorted((w.replace(".", "\\.") for w in words), key=len, reverse=True))


#: dots that end no sentence (the dot is matched first: looking behind at every character is slow)
MASK_DOT = "\\.(?:" + "|".join(
    [
        r"(?<=[\p{L}\p{N}]\.)(?=\p{N})",
        r"(?<=[\p{L}\p{N}/_-]\.)(?=[\p{Ll}_/])",
        r"(?<=(?<![\p{L}\p{M}])\p{L}\.)(?=\p{L}\p{M}*\.)",
        rf"(?<=(?<![\p{{L}}\p{{M}}])(?:{_alternatives(TITLES)})\.)",
        rf"(?<=(?<![\p{{L}}\p{{M}}])(?:{_alternatives(NUMBERED)})\.)(?=\s*\p{{N}})",
        rf"(?<=(?<![\p{{L}}\p{{M}}\p{{N}}])(?<!\b(?:{LABELLED}) )\p{{Lu}}\.)(?=\s*\S)(?!\s+(?:{OPENERS})[\s,])",
        r"(?<=(?:^|\n)[ \t]{0,8}\p{N}{1,3}\.)(?=\s)",
        rf"(?<=(?<![\p{{N}}.,])\p{{N}}{{1,2}}\.)(?=\s+(?:{MONTHS})\b)",
        r"(?<=(?:[ดศ]ร|ผศ|รศ|พ|ค|น)\.)(?=[\u0e00-\u0e7f])",
    ]
) + ")"
#: an address, without the marks that end the sentence it stands in
URL = r"(?:https?://|www\.)[^\s<>\"“”«»]*[^\s<>\"“”«».,;:!?)]"
#: marks inside speech whose speaker follows (the mark and the closing quote are matched first)
MASK_SPEECH = f"[{_ANY},](?=[{_ANY}]*[ \\u00a0\\u202f]?[”“»\"’」』](?:" + "|".join(
    [
        f"\\s+\\p{{Lu}}[\\p{{L}}’-]+\\s+(?:{SAID})\\b",
        "と",
        f"(?=[一-鿿])[^{_ANY}\\n“”「」]{{1,14}}?(?:{SAID_ZH})(?=[。，！：,.]|\\s|$)",
        f"\\s+(?=[\\u0900-\\u097f])[^{_ANY}\\n“”]{{1,40}}?(?:{SAID_HI})",
        f"\\s*،?\\s*(?:{SAID_AR})",
        f"\\s*(?=[\\u0e00-\\u0e7f])(?:[\\u0e00-\\u0e7f]{{1,20}}?)?(?:{SAID_TH})",
    ]
) + "))"
#: blanks between the items of a menu line (short items, no sentence marks)
MENU = r"(?m)^[^\s.!?。]{1,16}(?:[ ][^\s.!?。]{1,12}){0,2}(?:[ \t　]{2,}[^\s.!?。]{1,16}(?:[ ][^\s.!?。]{1,12}){0,2})+[ \t]*$"

_START = r"(?:[—–-]\s*)?[\p{Ps}\p{Pi}„\"'¿¡«“‘]*[   ]?(?:\p{Lu}|\p{Lt}|\p{Lo}|\p{N}|\p{Ll}\p{Lu}|[#@©$€£§•*])"
_CLOSED = f"(?:[ \\u00a0\\u202f]?»|[{_CLOSE}])*"
_TH = "[\\u0e00-\\u0e7f]"
#: (pattern, what is put for it): unit ends within a line or paragraph
ENDS = (
    (rf"((?:[{_END}{_OWN}]+|[;\u037e](?<=[\u0370-\u03ff\u1f00-\u1fff].)){_CLOSED})(?=\s+{_START})", f"$1{BREAK}"),
    (rf"([{_END}](?<=\p{{Ll}}{{2}}.)[{_END}]*)(?=\p{{Lu}}[\p{{Ll}}’' ]|\p{{Lu}}{DOT} |[“«„¿¡(]\p{{Lu}}|« \p{{Lu}})", f"$1{BREAK}"),
    (r"([.؟!](?<=[\u0600-\u06ff]{2}.))(?=[\u0600-\u06ff]{2})", f"$1{BREAK}"),
    (rf"([{_OWN}]+{_CLOSED})(?=[\p{{L}}])", f"$1{BREAK}"),
    (rf"([{_WIDE}]+[{_SHUT}]*)(?=[^{_WIDE}{_SHUT}])", f"$1{BREAK}"),
    (rf"([\u0e00-\u0e7f”!?\"’)…][ \t\u00a0\r\n]+)(?=[“\"‘(]*{_TH})", f"$1{BREAK}"),
)


def masked(text: Column) -> Column:
    """``text`` with every mark that ends nothing masked, one character for one."""
    addresses = F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    hidden = F.aggregate(addresses, text, lambda t, u: F.replace(t, u, F.translate(u, ".?!;", DOT * 4)))
    urls = F.when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("www.")), hidden).otherwise(text)
    out = F.regexp_replace(urls, MASK_DOT, DOT)
    out = F.regexp_replace(out, MASK_SPEECH, SPEECH)
    # a menu line's blanks, which in scripts that end sentences by blanks would part its items
    thai = F.regexp_replace(out, rf"(?<={_TH})[ \t](?=[ \t])|(?<=[ \t])[ \t](?={_TH})", GAP)
    return F.when(out.rlike(_TH) & out.rlike(MENU), thai).otherwise(out)


def marked(text: Column) -> Column:
    """``text``, masked, with ``BREAK`` put in where a unit ends; splitting there keeps positions."""
    plain = F.regexp_replace(text, f"[{DOT}{SPEECH}{BREAK}{GAP}]", "�")  # such characters of the text's own
    out = masked(plain)
    for pattern, to in ENDS:
        out = F.regexp_replace(out, pattern, to)
    paragraphs = plain.rlike(r"\n[ \t ]*\r?\n")
    lines = F.when(paragraphs, F.regexp_replace(out, r"(\n[ \t\r ]*\n)", f"$1{BREAK}"))
    return lines.otherwise(F.regexp_replace(out, r"(\n|\r(?!\n))", f"$1{BREAK}"))


_SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LEAD = f"^{_SPACE}*"


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", content: bool = False) -> DataFrame:
    """(key, unit_no from 1, start_pos, length[, unit]) of each sentence or other unit.

    What is shuffled are positions, not text, unless ``content`` is asked for.
    """
    base = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.col("_t").rlike(r"\S"))
    pieces = base.select("_k", F.xxhash64("_t").alias("_h"), F.posexplode(F.split(marked(F.col("_t")), BREAK)).alias("_i", "_p"))
    lead = F.length("_p") - F.length(F.regexp_replace("_p", _LEAD, ""))
    bare = F.regexp_replace(F.regexp_replace("_p", _LEAD, ""), f"{_SPACE}+$", "")
    once = pieces.groupBy("_k", "_h", "_i").agg(F.max(F.length("_p")).alias("_n"), F.max(lead).alias("_lead"), F.max(F.length(bare)).alias("_len"))
    before = Window.partitionBy("_k", "_h").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("start_pos", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("_lead")).cast("int"))
    full = placed.where("_len > 0")
    order = Window.partitionBy("_k", "_h").orderBy("_i")
    out = full.select("_k", "_h", F.row_number().over(order).alias("unit_no"), "start_pos", F.col("_len").cast("int").alias("length"))
    if content:
        source = base.select("_k", F.xxhash64("_t").alias("_h"), "_t").dropDuplicates(["_k", "_h"])
        out = out.join(source, ["_k", "_h"]).withColumn("unit", F.expr("substring(_t, start_pos + 1, length)"))
        return out.select(F.col("_k").alias(key), "unit_no", "start_pos", "length", "unit")
    return out.select(F.col("_k").alias(key), "unit_no", "start_pos", "length")
