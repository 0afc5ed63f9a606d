"""Markup residue in text: which languages a file carries, and its clean, structured text.

Method: a file is a tree: file, blocks of adjacent lines, elements that are opened on one line and
closed on a later one (nested as the document's nodes are), lines, marks.  Each line, element and
block is plain or of one markup language; parent and child are coupled by potentials,
marks are emitted by the language of their line.  Sum-product messages go up to the file
and down again and yield each line's marginals.  All potentials are counts over labelled
pages, which are invented by ``pages`` (``PAGES`` of them: a bounded, documented sample).

Lines with characters that no encoding stands for (replacement and C1 characters) emit marks by
potentials of their own, counted on damaged pages: garbled text makes accidental marks.  All lines of
a file are in its tree; of those that can hold no mark only their place is shuffled.

Lines shown inside a code block belong to the language of the block's fence, whatever
they look like.

Defined results: null and blank lines are text without marks; files without marks give
no rows; a line delivered twice counts once; a file's marks are read in line order.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYNTAX = ("plain", "html", "markdown", "wiki", "latex")
PAGES = 900
SEED = 11
SURE = 0.5  # marginal from which a language counts as used

# Element names of HTML.
TAGS = "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col dd del details dfn div dl dt em fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
_T = "|".join(sorted(TAGS, key=len, reverse=True))

#: mark -> pattern; what a mark tells is learned
MARKS = {
    "tag": rf"(?i)</?(?:{_T})(?:\s+[a-z][\w:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s<>\"']+))?)*\s*/?>",
    "tag_open": rf"(?i)<(?:{_T})(?:\s+[\w:-]+=[^<>]*)?\s*$",
    "attribute": r"^\s*[a-z][a-z-]*=(?:\"[^\"]*\"|'[^']*')(?:\s+[a-z-]+=(?:\"[^\"]*\"|'[^']*'))*\s*/?>",
    "entity": r"&(?:[A-Za-z][A-Za-z0-9]{1,7}|#\d{2,6}|#x[0-9A-Fa-f]{2,5});",
    "comment": r"<!--.*?-->|<!--\s|<!(?i:doctype)",
    "hash_title": r"^#{1,6}\s+\S",
    "hash_closed": r"^(#{1,6})\s+\S.*\S\s+\1\s*$",
    "underline": r"^={3,}\s*$",
    "md_link": r"(?<!!)\[[^\[\]]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)",
    "md_image": r"!\[[^\[\]]*\]\([^()\s]+\)",
    "md_ref": r"^\[[^\[\]]+\]:\s+\S+|\[[^\[\]]+\]\[[^\[\]]*\]",
    "star_bold": r"(?<![*\w])\*\*[^\s*](?:[^*]*[^\s*])?\*\*(?!\*)",
    "star_both": r"\*\*\*[^\s*][^*]*\*\*\*",
    "star_one": r"(?<![*\w\\])\*[^\s*](?:[^*]*[^\s*])?\*(?![*\w])",
    "bar_bold": r"(?<!\w)__(?![A-Z]+__)[^\s_](?:[^_]*[^\s_])?__(?!\w)",
    "bar_one": r"(?<![\w\\])_[^\s_](?:[^_]*[^\s_])?_(?!\w)",
    "strike": r"~~[^\s~][^~]*~~",
    "fence": r"^(?:```|~~~)",
    "tick": r"(?<!`)`[^`'\s](?:[^`']*[^`\s])?`(?!`)",
    "rule_row": r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{2,}:?\s*\|",
    "bar_row": r"^\s*\|.*\|\s*$",
    "quote": r"^>\s",
    "dash_item": r"^\s*[-+]\s+\S",
    "star_item": r"^\s*\*\s+\S",
    "equal_title": r"^(={2,6})[^=].*[^=]\1\s*$",
    "wiki_link": r"\[\[[^\[\]]+\]\]",
    "wiki_outer": r"\[https?://\S+\s+[^\]]+\]",
    "template": r"\{\{[^{}]*\}\}|^\{\{\S|^\}\}\s*$",
    "field": r"^\|\s*[\w ]+=",
    "quote3": r"(?<!')'''(?!')[^']+'''(?!')",
    "quote2": r"(?<!')''(?!')[^']+''(?!')",
    "wiki_table": r"^\{\||^\|\}|^\|-",
    "magic": r"__[A-Z]{3,}__",
    "wiki_tag": r"(?i)</?(?:ref|nowiki|gallery|references|syntaxhighlight)\b[^<>]*>",
    "deep_item": r"^[*#:;]{2,}\s*\S",
    "redirect": r"(?i)^#redirect\b",
    "tex_command": r"\\(?:[a-zA-Z]+\*?(?:\[[^\]]*\])?\{|item\b|par\b|noindent\b|LaTeX\b)",
    "tex_block": r"\\(?:begin|end)\{",
    "tex_math": r"\$[^$\s](?:[^$]*[^\s$])?\$(?!\d)(?<=[^\s$]\$)",
    "tex_symbol": r"\\(?:alpha|beta|gamma|le|ge|sum|frac|sqrt|int|cdot|times|infty|pi|sigma|lambda|ldots|quad)\b",
    "tex_display": r"\\\[|\\\]|\\\(|\\\)|\$\$",
    "tex_quote": r"``[^`']+''",
    "tex_align": r"&\s*=|\\\\\s*$",
    "tex_percent": r"^%+\s+[^\W\d_]{2}",
}
NAMES = list(MARKS)
_COMPILED = [re.compile(p) for p in MARKS.values()]

#: JVM-side: a line without any of these has no mark (one class, so that scanning is cheap)
POSSIBLE = r"[<>&#*_~`|={\[\\$!+\]}]|''|^\s*[-%]|\w=[\"']"


#: undecodable text
DAMAGED = re.compile(r"[\x80-\x9f\ufffd]")
HURT = len(MARKS)  # stands among a line's marks for damage
PLAIN = "x"  # stands for a line that can hold no mark


def marks_of(line: str) -> list[int]:
    return [k for k, p in enumerate(_COMPILED) if p.search(line)]


# Elements that are never closed.
_VOID = {"area", "br", "hr", "img", "input", "link", "meta", "param", "source", "wbr"}
_TAG = re.compile(rf"(?i)<(/?)({_T})(?:\s[^<>]*)?(/?)>")


def elements(lines: list[str]) -> list[tuple[int, int]]:
    """(first, last) positions of the elements that are opened on one line and closed on a later one; they nest."""
    out: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    for i, line in enumerate(lines):
        if "<" not in line:
            continue
        for m in _TAG.finditer(line):
            tag = m.group(2).lower()
            if tag in _VOID or m.group(3):
                continue
            if not m.group(1):
                open_.append((tag, i))
                continue
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            if k is not None:
                if open_[k][1] < i:
                    out.append((open_[k][1], i))
                del open_[k:]  # what was opened inside and not closed ends with it
    return sorted(set(out), key=lambda x: (x[0], -x[1]))


# --- labelled pages -----------------------------------------------------------------


class _Pages:
    """Invented pages whose every line is labelled."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("bdfgklmnprstv") + self.r.choice("aeiouéäи") for _ in range(self.r.randint(1, 4)))

    def damaged(self, lines: list[str], plain: bool) -> list[str]:
        """Lines with some letters lost; or, of plain ones, text of a wide encoding read byte by byte."""
        r = self.r
        if plain and r.random() < 0.7:
            chars, code = r.choice([((0x3042, 0x3093), "cp932"), ((0x4E00, 0x9F00), "gb18030"), ((0x4E00, 0x5FFF), "cp932"), ((0x410, 0x44F), "utf_8"), ((0x3B1, 0x3C9), "utf_8"), ((0x4E00, 0x9F00), "utf_8"), ((0xAC00, 0xD700), "euc_kr")])
            make = lambda: " ".join("".join(chr(r.randint(*chars)) for _ in range(r.randint(2, 12))) for _ in range(r.randint(1, 6)))
            return [make().encode(code, "ignore").decode("latin_1") for _ in range(r.randint(1, 4))]
        letters = [c for x in lines for c in x if c.isalpha()] or [""]
        gone = r.choice(letters)
        return [x.replace(gone, r.choice("\ufffd\ufffd\x92\x85"), 2) if gone else x for x in lines]

    def text(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(3, 12))).capitalize() + "."

    def plain(self) -> list[str]:
        w, t, r, n = self.word, self.text, self.r, self.r.randint(1, 90)
        return r.choice([
            [t(), t(), t()], [f"- {t()}", f"- {t()}"], [f"* {t()}", f"* {t()}"], ["* * *"], ["*****"], [f"{n}. {t()}"], [f"{w()} ____ {w()}, see [{n}] {t()}"],
            [f"C:\\{w()}\\{w()} and {w()}_{w()}_{n}.txt"], [f"it cost ${n} and ${n + 1} {t()}"], [f"{n} < {n + 4} and {w()} > {w()} {n} * {n} * 3"], [f"x = y_{n} + z_{n}"],
            [f"the R&D of {w()} <{n} --> #{n}"], [f"www.{w()}.example/{w()}_{w()}.html {t()}"], [f"> {t()}"], [f"{w()} {{sic}} [{w()}] {t()}"], [f"{n}% of {w()} & {w()} Co."],
            [f"+ {w()}", f"+ {w()}"], ["-----"], [f"{w()} | {n} | {n}", f"{w()} | {n} | {n}"], [f"# {n}: {w()}"], [f"_____ {w()}"], [f"{w()} = {n}"], [f"|{w()}{n} |{w()}"], ["========"],
        ])

    def html(self) -> list[str]:
        w, t, r, n = self.word, self.text, self.r, self.r.randint(1, 90)
        one = [f"<h2>{w()}</h2>"], [f'<p class="{w()}">{t()}', f"<b>{t()}</b></p>"], ["<ul>", f"  <li>{t()}</li>", f"  <li>{t()}</li>", "</ul>"], ["<div", f'   style="margin:{n}">{t()}</div>']
        nest = ["<div>", f"<p>{t()}</p>", "<ul>", f"<li>{t()}", f"{t()}</li>", "</ul>", t(), "</div>"], ["<blockquote>", t(), t(), "</blockquote>"]
        two = [f"<table><tr><th>{w()}</th><td>{n}</td></tr></table>"], [f"<!-- {w()} -->"], [f'{t()} <a href="/{w()}">{w()}</a> {t()}'], [f"{t()}&nbsp;{t()}"], [f"{w()}<br/> {t()}"], [f"{t()} <SPAN class=x>{w()}</SPAN>"]
        return r.choice([*one, *two, *nest, ["<pre><code>", "</code></pre>"], [f"{t()} &mdash; &#8212; {t()}"], [f"<P>{t()}"], [f'<img src="{w()}.png" alt="{w()}">']])

    def markdown(self) -> list[str]:
        w, t, r, n = self.word, self.text, self.r, self.r.randint(1, 90)
        return r.choice([
            [f"{'#' * r.randint(1, 4)} {w()} {w()}"], [f"## {w()} ##"], [w(), "======="], [f"- **{w()}** {t()}", f"- [{w()}]({w()}/{n}.md)", f"  * {t()}"], ["```python", "```"],
            [f"| {w()} | {w()} |", "|:---|---:|", f"| {n} | {n} |"], [f"> {t()}", f"> __{w()}__ {t()}"], [f"![{w()}](img/{n}.png) {t()}"], [f"{t()} **{w()}** {t()}"], [f"{t()} ***{w()}*** ~~{w()}~~"],
            [f"{t()} [{w()}](https://www.{w()}.example/a) {t()}"], [f"{t()} `{w()}_{n}()` {t()}"], [f"{t()} *{w()}* {t()}"], [f"{t()} _{w()} {w()}_ {t()}"], [f"[{n}]: https://{w()}.example"], [f"# {w()}", t()],
        ])

    def wiki(self) -> list[str]:
        w, t, r, n = self.word, self.text, self.r, self.r.randint(1, 90)
        return r.choice([
            [f"== {w()} =="], [f"=== {w()} ===", t()], ["{{Infobox " + w(), f"| name = {w()}", f"| size = {n}", "}}"], [f"{t()} [[{w()}]]s {t()}"], [f"[[Category:{w()}]]"],
            [f"* [[{w()}]] {t()}", f"** ''{w()}'' {t()}", f"# {t()}", f"# {t()}"], [f"'''{w()}''' {t()}"], ["{| class=\"wikitable\"", f"! {w()}", "|-", f"| {n} || {n}", "|}"], ["__TOC__"],
            [f"{t()} {{{{cite|{w()}|{n}}}}} {t()}"], [f"{t()}<ref>{w()}</ref>"], [f"[https://www.{w()}.example {w()}]"], [f"#REDIRECT [[{w()}]]"], [f"** {t()}", f"# {t()}"], [f"{t()} ''{w()}'' {t()}"],
        ])

    def latex(self) -> list[str]:
        w, t, r, n = self.word, self.text, self.r, self.r.randint(1, 90)
        return r.choice([
            [f"\\section{{{w()}}}\\label{{sec:{n}}}"], ["\\begin{itemize}", f"\\item {t()}", f"\\item \\textbf{{{w()}}} {t()}", "\\end{itemize}"], [f"\\[ \\sum_{{i=1}}^{{{n}}} i = n \\]"],
            ["\\begin{align}", f"  y &= {n}x^2 + \\frac{{a}}{{{n}}} \\\\", "  z &= \\sqrt{y}", "\\end{align}"], ["\\begin{verbatim}", "\\end{verbatim}"], [f"``{w()}'' --- {t()} $\\alpha={n}$"],
            [f"{t()} $x_{{{n}}} \\le {n}$ {t()}"], [f"{t()} \\cite{{{w()}}} {t()}"], [f"{t()} \\textit{{{w()}}}~\\cite{{{w()}}}, {t()}"], [f"\\title{{{w()}}}", f"% {w()}"], [f"$$ E = m c^{n} $$"],
        ])


def pages(n: int = PAGES, seed: int = SEED) -> list[list[tuple[str, list[str]]]]:
    """``n`` pages: each a list of blocks (language, lines)."""
    make, out = _Pages(seed), []
    for _ in range(n):
        r = make.r
        langs = [r.choice(SYNTAX[1:]) for _ in range(r.choice([0, 0, 1, 1, 2]))]
        blocks = []
        size = r.randint(2, 10)
        only = r.randrange(size) if langs and r.random() < 0.4 else None  # a page with markup in one place
        for at in range(size):
            lang = "plain" if not langs or (r.random() < 0.4 if only is None else at != only) else r.choice(langs)
            lines = [x for _ in range(1 if lang == "plain" else r.randint(1, 3)) for x in getattr(make, lang)()]
            if r.random() < 0.25:
                lines = make.damaged(lines, lang == "plain")
            if r.random() < 0.4:  # marks stand in running text
                where = r.randint(0, len(lines)) if lang == "plain" else 0
                lines[where:where] = [make.text() for _ in range(r.randint(1, 8))]
            blocks.append((lang, lines))
        out.append(blocks)
    return out


class Potentials:
    """Log potentials of the tree, counted on labelled pages."""

    def __init__(self, labelled: list[list[tuple[str, list[str]]]]):
        k = len(SYNTAX)
        emit, seen = np.full((2, k, len(NAMES)), 0.02), np.full((2, k), 0.5)  # sound and damaged lines
        block_given = np.full((k, k), 0.3)  # main language of the file (plain: at most one block isn't) -> block
        root = np.full(k, 1.0)
        line_given = np.full((k, k), 0.05)  # block or element -> line
        node_given = np.full((k, k), 0.05)  # block or element -> element
        for blocks in labelled:
            used = [lang for lang, _ in blocks if lang != "plain"]
            rich = SYNTAX.index(max(used, key=used.count)) if len(used) > 1 else 0
            root[rich] += 1
            for lang, lines in blocks:
                s = SYNTAX.index(lang)
                block_given[rich, s] += 1
                node_given[s, s] += len(elements(lines))
                for line in lines:
                    found, hurt = marks_of(line), int(DAMAGED.search(line) is not None)
                    own = s if found or lang == "plain" else 0
                    line_given[s, own] += 1
                    seen[hurt, own] += 1
                    emit[hurt, own, found] += 1
        self.root = np.log(root / root.sum())
        self.block = np.log(block_given / block_given.sum(1, keepdims=True))
        self.line = np.log(line_given / line_given.sum(1, keepdims=True))
        self.node = np.log(node_given / node_given.sum(1, keepdims=True))
        rate = emit / (seen[..., None] + 0.04)
        self.present, self.absent = np.log(rate), np.log1p(-np.minimum(rate, 0.99))
        self.bare = self.absent.sum(2)
        self.memo: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def emission(self, marks: list[int]) -> np.ndarray:
        """Log likelihood of a line's marks (``HURT`` among them: the line is damaged) under each language."""
        at, hurt = [m for m in marks if m != HURT], int(HURT in marks)
        return self.bare[hurt] + (self.present[hurt][:, at] - self.absent[hurt][:, at]).sum(1) if at else self.bare[hurt]

    def _messages(self, lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of a block's lines, and their messages to the block (line x block state)."""
        key = tuple(map(tuple, lines))
        if key not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            e = np.array([self.emission(x) for x in lines])
            self.memo[key] = e, np.logaddexp.reduce(self.line[None, :, :] + e[:, None, :], axis=2)
        return self.memo[key]

    def _rise(self, node: list[int] | tuple) -> tuple[np.ndarray, np.ndarray, list]:
        """What a line (its marks) or an element (its children) tells: its own states, its parent's, and the same of its children."""
        add = np.logaddexp.reduce
        if isinstance(node, list):
            own, below, down = self.emission(node), [], self.line
        else:
            below = [self._rise(c) for c in node]
            own, down = sum((b[1] for b in below), np.zeros(len(SYNTAX))), self.node
        return own, add(down + own[None, :], axis=1), below

    def _fall(self, node: list[int] | tuple, told: tuple[np.ndarray, np.ndarray, list], above: np.ndarray) -> list[np.ndarray]:
        """Marginals of the lines below a node; ``above``: what the rest of the tree tells of its parent's states."""
        add = np.logaddexp.reduce
        own, _, below = told
        if isinstance(node, list):
            m = add(above[:, None] + self.line, axis=0) + own
            return [np.exp(m - add(m))]
        whole = add(above[:, None] + self.node, axis=0) + own
        return [x for c, t in zip(node, below) for x in self._fall(c, t, whole - t[1])]

    def marginals(self, blocks: list[list[list[int] | tuple]]) -> list[np.ndarray]:
        """For each block (lines as lists of marks, elements as tuples of what they hold): lines x languages, by messages up and down the tree."""
        add = np.logaddexp.reduce
        ups, beliefs = [], []
        for nodes in blocks:
            if any(isinstance(x, tuple) for x in nodes):
                told = [self._rise(x) for x in nodes]
                to_block = np.array([t[1] for t in told])
                beliefs.append((told, to_block))
            else:
                beliefs.append(self._messages(nodes))
            ups.append(beliefs[-1][1].sum(0))
        to_root = [add(self.block + up[None, :], axis=1) for up in ups]
        root = self.root + sum(to_root)
        out = []
        for nodes, (e, to_block), up, mine in zip(blocks, beliefs, ups, to_root):
            down = add((root - mine)[:, None] + self.block, axis=0)  # file to block, without the block's own word
            rest = (down + up)[None, :] - to_block  # block without each child's own word
            if isinstance(e, list):
                out.append(np.array([m for x, t, r in zip(nodes, e, rest) for m in self._fall(x, t, r)]))
            else:
                m = add(rest[:, :, None] + self.line[None, :, :], axis=1) + e
                out.append(np.exp(m - add(m, axis=1)[:, None]))
        return out


@lru_cache(None)
def potentials() -> Potentials:
    return Potentials(pages())


_FENCES = ((re.compile(r"^\s*(```|~~~)"), None, "markdown"), (re.compile(r"(?i)<pre\b|<code>\s*$"), re.compile(r"(?i)</pre>|^\s*</code>"), "html"), (re.compile(r"\\begin\{(verbatim|lstlisting)\*?\}"), re.compile(r"\\end\{(verbatim|lstlisting)\*?\}"), "latex"), (re.compile(r"(?i)<(nowiki|syntaxhighlight)\b[^<>]*>\s*$"), re.compile(r"(?i)</(nowiki|syntaxhighlight)>"), "wiki"))


def code_lines(lines: list[tuple[int, str]]) -> dict[int, str]:
    """Positions inside code blocks (fences excluded) -> language of the fence; an unclosed fence holds nothing."""
    out: dict[int, str] = {}
    i = 0
    while i < len(lines):
        for start, stop, lang in _FENCES:
            m = start.search(lines[i][1])
            if not m or stop is not None and stop.search(lines[i][1], m.end()):
                continue
            end = next((j for j in range(i + 1, len(lines)) if (stop.search(lines[j][1]) if stop is not None else lines[j][1].strip().startswith(m.group(1)))), None)
            if end is not None:
                out.update(dict.fromkeys(range(i + 1, end), lang))
                i = end
                break
        i += 1
    return out


def _observed(line: str) -> list[int]:
    """The line's marks, ``HURT`` with them if it is damaged."""
    return [] if line == PLAIN else marks_of(line) + [HURT] * (DAMAGED.search(line) is not None)


def _nodes(at: list[int], spans: list[tuple[int, int]], marks: dict[int, list[int]]) -> list[list[int] | tuple]:
    """Lines ``at`` as nodes, those within one of the nested ``spans`` as its children."""
    out: list[list[int] | tuple] = []
    k = 0
    while k < len(at):
        span = next((x for x in spans if x[0] == at[k]), None)
        if span is None:
            out.append(marks[at[k]])
            k += 1
            continue
        inside = [i for i in at[k:] if i <= span[1]]
        out.append(tuple(_nodes(inside, [x for x in spans if x != span and x[0] >= span[0] and x[1] <= span[1]], marks)))
        k += len(inside)
    return out


def label(lines: list[tuple[int, str]], model: Potentials) -> list[tuple[str, float, bool]]:
    """(language, marginal, in code) of each of the sorted lines of one file."""
    inside = code_lines(lines)
    spans = elements(["" if i in inside else text for i, (_, text) in enumerate(lines)])
    holds = {i for a, z in spans for i in range(a + 1, z + 1)}  # lines an element holds together with the one before
    blocks: list[list[int]] = []
    last = None
    for i, (no, text) in enumerate(lines):
        if i in inside or not text.strip():
            last = no if i in inside or i in holds else None
            continue
        if i not in holds and (last is None or no != last + 1) or not blocks:
            blocks.append([])
        blocks[-1].append(i)
        last = no
    marks = {i: _observed(lines[i][1]) for b in blocks for i in b}
    found = model.marginals([_nodes(b, [x for x in spans if b[0] <= x[0] <= b[-1]], marks) for b in blocks])
    out: list[tuple[str, float, bool]] = [("plain", 1.0, False)] * len(lines)
    for b, m in zip(blocks, found):
        for i, row in zip(b, m):
            k = int(row.argmax())
            out[i] = (SYNTAX[k], float(row[k]), False)
    for i, lang in inside.items():
        out[i] = (lang, 1.0, True)
    return out


def _by_file(lines: DataFrame) -> DataFrame:
    once = lines.groupBy("file_id", "line_no").agg(F.max("line").alias("line"))
    return once.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))


def languages(lines: DataFrame) -> DataFrame:
    """(file_id, syntax, certainty): one row per file and markup language used in it.

    A file's lines come to one task, which holds one file at a time; a line that can hold no mark
    travels as ``PLAIN``.
    """
    model = potentials()
    line = F.col("line")
    possible = lines.select("file_id", "line_no", F.when(line.rlike(POSSIBLE), line).when(line.rlike(r"\S"), F.lit(PLAIN)).otherwise(F.lit("")).alias("line"))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, sure = [], [], []
            for file_id, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [(x["line_no"], x["line"]) for x in items]
                if not any(t and t != PLAIN and marks_of(t) for _, t in own):
                    continue
                best: dict[str, float] = {}
                for lang, p, _ in label(own, model):
                    if lang != "plain":
                        best[lang] = max(best.get(lang, 0.0), p)
                for lang, p in sorted(best.items()):
                    ids.append(file_id)
                    langs.append(lang)
                    sure.append(round(p, 6))
            yield pa.RecordBatch.from_pydict({"file_id": pa.array(ids, pa.int64()), "syntax": pa.array(langs, pa.string()), "certainty": pa.array(sure, pa.float64())})

    return _by_file(possible).mapInArrow(infer, "file_id long, syntax string, certainty double")


# --- conversion -----------------------------------------------------------------------


def _entities(text: str) -> str:
    import html

    return html.unescape(text)


def _without_commands(text: str) -> str:
    """LaTeX text without its commands; what they are put around stays, but for labels and citations."""
    text = re.sub(r"~?\\(?:label|cite|ref|pageref|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    while (new := re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)) != text:
        text = new
    text = re.sub(r"\\(LaTeX|TeX)\b\s*(?:\{\})?", r"\1 ", text)
    text = re.sub(r"\\[a-zA-Z]+\*?(?:\{\}|(?![a-zA-Z{])) ?", "", text)
    text = re.sub(r"\\([%&_#${}])", r"\1", re.sub(r"\\\\(?:\[[^\]]*\])?", " ", text))
    return re.sub(r"``([^`']*)''", r"“\1”", text).replace("---", "—").replace("~", " ")


def _inline(text: str, lang: str) -> str:
    """One line's text without the marks of its language; formulas keep their source."""
    sub = re.sub
    if lang == "html":
        text = sub(r"<!--.*?-->", "", text)
        text = sub(r"(?i)<br\s*/?>", " ", text)
        text = sub(r"(?i)<(code|kbd|samp|tt)(?:\s[^<>]*)?>(.*?)</\1\s*>", r"`\2`", text)  # code stays marked as such
        text = sub(rf"(?i)</?(?:{_T})(?:\s[^<>]*)?/?>", "", text)
        text = sub(r"^\s*[a-z-]+=\"[^\"]*\"\s*>", "", text)
        text = sub(rf"(?i)<(?:{_T})(?:\s[^<>]*)?$", "", text)
        return _entities(text).replace("\xa0", " ").strip()
    if lang == "markdown":
        text = sub(r"!\[([^\[\]]*)\]\([^()\s]*\)", r"\1", text)
        text = sub(r"\[([^\[\]]+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", text)
        text = sub(r"\[([^\[\]]+)\]\[[^\[\]]*\]", r"\1", text)
        for _ in range(3):
            text = sub(r"(\*{1,3})(\S(?:[^*]*\S)?)\1", r"\2", text)
        text = sub(r"(?<!\w)(_{1,2})(\S(?:[^_]*\S)?)\1(?!\w)", r"\2", text)
        return sub(r"~~(.+?)~~", r"\1", text).strip()  # code and formulas stay marked as such
    if lang == "wiki":
        text = sub(r"(?i)\[\[(?:file|image|category):[^\[\]]*?(?:\|([^\[\]|]*))?\]\]", lambda m: m.group(1) or "", text)
        text = sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]+)\]\]", r"\1", text)
        text = sub(r"\[https?://\S+\s+([^\]]+)\]", r"\1", text)
        text = sub(r"(?is)<ref\b[^<>]*>.*?</ref>|</?(?:ref|nowiki)\b[^<>]*>", "", text)
        text = sub(r"\{\{[^{}]*\}\}", "", sub(r"'{2,5}", "", text))
        return sub(r"__[A-Z]{3,}__", "", text).strip()
    if lang == "latex":
        # formulas keep their source, all else loses its commands
        parts = re.split(r"(\$[^$\s](?:[^$]*[^\s$])?\$|\\\(.*?\\\))", text)
        return "".join(x if k % 2 else _without_commands(x) for k, x in enumerate(parts)).strip()
    return text.rstrip()


def convert(lines: list[tuple[int, str]], model: Potentials) -> list[tuple[int, str, str, int | None, bool | None, str]]:
    """(line_no, syntax, kind, level, ordered, text): the clean units of one file.

    Kinds: heading, item, code, formula, cell (a table's row), quote, text.  ``level``: rank of a heading
    (from 1), depth of an item (from 1), else null; ``ordered``: whether an item's list is numbered.
    """
    out: list[tuple[int, str, str, int | None, bool | None, str]] = []
    math = False
    nest: list[bool] = []  # open lists of HTML and LaTeX: numbered or not
    indents: list[int] = []  # open items of Markdown
    labels = label(lines, model)
    for i, ((no, raw), (lang, _, code)) in enumerate(zip(lines, labels)):
        if code:
            out.append((no, lang, "code", None, None, _entities(raw) if lang == "html" else raw))
            continue
        text, kind, level, ordered = raw, "text", None, None
        low = raw.strip().lower()
        if math and lang != "latex" and "$$" not in low:
            out.append((no, lang, "formula", None, None, raw.strip()))
            continue
        if lang in ("markdown", "latex") and "$$" in low and re.fullmatch(r"(?:\$\$)?[^$]*(?:\$\$)?", low):
            math = math ^ (low.count("$$") == 1)
            if formula := raw.replace("$$", "").strip():
                out.append((no, lang, "formula", None, None, formula))
            continue
        if lang == "html":
            m = re.match(r"<h([1-6])\b", low)
            kind, level = ("heading", int(m.group(1))) if m else ("item", None) if low.startswith("<li") else ("cell", None) if re.match(r"<tr\b|<t[dh]\b", low) else ("text", None)
            if kind == "item":
                level, ordered = max(1, len(nest)), bool(nest and nest[-1])
            for tag in re.findall(r"<(/?[uo]l)\b", low):
                nest = nest[:-1] if tag[0] == "/" else [*nest, tag == "ol"]
            text = re.sub(r"(?i)</t[dh]>\s*<t[dh][^<>]*>", "\t", text)
        elif lang == "markdown" or lang == "plain" and indents and re.match(r"\s*(?:[-+*]|\d+[.)])\s+\S", text):
            if re.match(r"(```|~~~)", low) or re.fullmatch(r"[|:\s-]+", low) or re.match(r"^\[[^\[\]]+\]:\s", low):
                continue
            if re.fullmatch(r"={3,}|-{3,}", low) and out and out[-1][0] == no - 1:
                out[-1] = (out[-1][0], lang, "heading", 1 if low[0] == "=" else 2, None, out[-1][5])
                continue
            if m := re.match(r"(#{1,6})\s+(.*?)(?:\s+#+)?\s*$", text):
                kind, level, text = "heading", len(m.group(1)), m.group(2)
            elif m := re.match(r"(\s*)([-+*]|\d+[.)])\s+(.*)", text):
                while indents and indents[-1] > len(m.group(1)):
                    indents.pop()
                if not indents or indents[-1] < len(m.group(1)):
                    indents.append(len(m.group(1)))
                kind, level, ordered, text = "item", len(indents), m.group(2)[0].isdigit(), m.group(3)
            elif m := re.match(r">\s?(.*)", text):
                kind, text = "quote", m.group(1)
            elif re.match(r"\s*\|.*\|\s*$", text):
                kind, text = "cell", "\t".join(x.strip() for x in text.strip().strip("|").split("|"))
        elif lang == "wiki":
            if re.match(r"\{\||\|\}|\|-|\{\{[^{}]*$|\}\}\s*$", low):
                continue
            if m := re.match(r"(={1,6})\s*(.*?)\s*\1\s*$", text):
                kind, level, text = "heading", len(m.group(1)), m.group(2)
            elif m := re.match(r"([*#:;]+)\s*(.*)", text):
                kind, level, ordered, text = "item", len(m.group(1)), m.group(1)[-1] == "#", m.group(2)
            elif m := re.match(r"[|!]\s*(.*)", text):
                kind, text = "cell", re.sub(r"\s*(?:\|\||!!)\s*", "\t", m.group(1))
        elif lang == "latex":
            if m := re.match(r"\\(begin|end)\{(\w+)\*?\}", low):
                math = m.group(1) == "begin" and m.group(2) in ("align", "equation", "gather", "displaymath", "math", "eqnarray")
                if m.group(2) in ("itemize", "enumerate", "description"):
                    nest = [*nest, m.group(2) == "enumerate"] if m.group(1) == "begin" else nest[:-1]
                continue
            if re.match(r"%", low):
                continue
            if m := re.match(r"\\(part|chapter|(?:sub)*section|title)\*?\{(.*?)\}", text.strip()):
                kind, level, text = "heading", {"part": 1, "title": 1, "chapter": 1}.get(m.group(1), 2 + m.group(1).count("sub")), m.group(2)
            elif m := re.match(r"\s*\\item\b\s*(.*)", text):
                kind, level, ordered, text = "item", max(1, len(nest)), bool(nest and nest[-1]), m.group(1)
            elif math or re.match(r"\\\[", low):
                text = re.sub(r"\\\[|\\\]|\\\\\s*$", "", text).strip()
                out.append((no, lang, "formula", None, None, text))
                continue
        if kind != "item" and text.strip() and not raw[:1].isspace():
            indents = []
        clean = _inline(text, "markdown" if lang == "plain" and kind == "item" else lang)
        if clean or not raw.strip():
            out.append((no, lang, kind, level, ordered, clean))
    return out


def clean(lines: DataFrame) -> DataFrame:
    """The files that carry markup, as (file_id, line_no, syntax, kind, level, ordered, text): see :func:`convert`."""
    model = potentials()
    rich = languages(lines).where(F.col("certainty") > SURE).select("file_id").distinct()
    whole = lines.select("file_id", "line_no", F.coalesce("line", F.lit("")).alias("line")).join(rich, "file_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, *unit) for f, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for unit in convert([(x["line_no"], x["line"]) for x in items], model)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_id", "line_no", "syntax", "kind", "level", "ordered", "text"])

    return _by_file(whole).mapInArrow(run, "file_id long, line_no int, syntax string, kind string, level int, ordered boolean, text string")
