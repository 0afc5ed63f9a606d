"""Text decoded with the wrong character encoding: finding it and restoring it.

Method: adjacent character pairs are scored by their mutual information in the whole
corpus; the runs of improbable pairs are isolated as maximum-scoring segments; inverse
mappings (back to bytes by the encoding that was used, forward by the one that should
have been) are tried only inside those runs, and the one whose result is most probable
by the same scores is taken if it beats what was there.

Pair counts go into two hashed tables, which are sized by the number of distinct pairs: where
more than ``FILLED`` of the cells are taken, so that pairs never seen could pass for known, the
pairs are counted again in larger tables (2**``BITS`` to 2**``MOST_BITS`` cells: the model is bounded).  Lines whose bytes plainly betray a wrong decoding are
left out of the counts, else garbled text would look familiar; support is asked for as
a rate of the corpus, so that the model behaves alike at every size.

Defined results: null and empty lines are never cases; repeated lines give repeated
rows; text that was damaged beyond restoring (replacement characters, stray control
characters of the C1 range) is named, with what can be restored restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, MOST_BITS = 20, 25  # cells of one of the two pair tables, as a power of two
FILLED = 0.06  # share of cells taken from which the tables are too small: of pairs never seen 0.4 % meet two taken cells
POINTS = 0x110000  # code points
SUPPORT = 2e-7  # share of all pairs from which a pair counts as known
LEAST = 3  # and at least so many occurrences
IMPROBABLE = -2.0  # score of a pair without support
SEGMENT = 2.0  # least sum of improbability of a run that is looked into
GAIN = 0.8  # by so much a mapping's result must be more probable, per pair
LIVE = 0.0  # least mean score of a mapping's result
DEPTH = 3  # text may have been decoded wrongly several times over

# Encodings that text is wrongly decoded with, and those it is written in.
WRONG = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "cp1253", "iso8859_15", "cp1254", "iso8859_2", "gb18030", "cp932", "big5")
RIGHT = ("utf_8", "gb18030", "cp932", "euc_jp", "big5", "euc_kr", "cp1251", "koi8_r", "cp866", "cp1253", "cp1255", "cp1256", "cp874", "cp1250", "iso8859_2", "cp1254", "cp1257", "cp1252", "mac_roman", "cp437", "cp850")
WIDE = {"utf_8", "gb18030", "cp932", "euc_jp", "big5", "euc_kr"}

SUSPECT = "[^\\x00-\\x7f]"  # lines without such a character can't be cases


@lru_cache(None)
def byte_table(codec: str) -> np.ndarray:
    """Code point -> byte of a one-byte encoding, -1 where it has none; undefined bytes stand for themselves."""
    table = np.full(0x10000, -1, np.int16)
    for b in range(256):
        try:
            c = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            c = b
        if table[c] < 0:
            table[c] = b
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _cells(p: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's cell in the first and in the second table; the smaller count is taken (count-min)."""
    mixed = (p[:-1] * np.int64(2654435761) + p[1:] * np.int64(40503)) & np.int64(0x7FFFFFFFFFFF)
    return (mixed ^ (mixed >> 17)) & ((1 << bits) - 1), (1 << bits) + (((mixed >> 9) * np.int64(0x9E3779B1) >> 21) & ((1 << bits) - 1))


@lru_cache(None)
def _masks() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code point -> bit per encoding: it stands for a byte that leads two, leads three, follows in UTF-8."""
    two, three, tail = (np.zeros(0x10000, np.uint8) for _ in range(3))
    for bit, codec in enumerate(("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r")):
        b = byte_table(codec)
        two |= ((b >= 0xC2) & (b <= 0xDF)).astype(np.uint8) << bit
        three |= ((b >= 0xE0) & (b <= 0xEF)).astype(np.uint8) << bit
        tail |= ((b >= 0x80) & (b <= 0xBF)).astype(np.uint8) << bit
    return two, three, tail


def betrayed(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which lines of the joined text (``starts``: where each begins) show a wrong decoding by their bytes alone."""
    q = np.where(p < 0x10000, p, 0)
    two, three, tail = _masks()
    follows = tail[q]
    bad = (p == 0xFFFD) | ((p >= 0x80) & (p <= 0x9F))
    bad[:-1] |= (two[q[:-1]] & follows[1:]) > 0
    bad[:-2] |= (three[q[:-2]] & follows[1:-1] & follows[2:]) > 0
    high = ((p >= 0xA1) & (p <= 0xFF)) | ((p >= 0x2500) & (p <= 0x257F))
    dense = np.add.reduceat(high, starts, dtype=np.int64) > 0.3 * np.add.reduceat(p > 32, starts, dtype=np.int64)
    # Cyrillic in which capitals outnumber small letters is one Cyrillic encoding read as another
    cyrillic = (p >= 0x400) & (p <= 0x4FF)
    capital = ((p >= 0x410) & (p <= 0x42F)) | (p == 0x401)
    n = np.add.reduceat(cyrillic, starts, dtype=np.int64)
    swapped = (n >= 8) & (np.add.reduceat(capital, starts, dtype=np.int64) > 0.6 * n)
    return dense | swapped | np.logical_or.reduceat(bad, starts)


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(cell, n): counts of pairs, and of single code points as negative cells."""
    pairs, single = np.zeros(2 << bits, np.int64), np.zeros(POINTS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        lines = "\n".join(t for t in texts if t)
        if not lines:
            continue
        p = _points(lines + "\n")
        ends = np.flatnonzero(p == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        good = np.repeat(~betrayed(p, starts), ends + 1 - starts)
        single += np.bincount(p[good], minlength=POINTS)
        inside = good[:-1] & (p[:-1] != 10) & (p[1:] != 10)
        for cell in _cells(p, bits):
            if bits == BITS:
                pairs += np.bincount(cell[inside], minlength=len(pairs))
            else:
                np.add.at(pairs, cell[inside], 1)
    for table, sign in ((pairs, 1), (single, -1)):
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at if sign > 0 else -1 - at, pa.int64()), "n": pa.array(table[at], pa.int64())})


class Model:
    """Pair scores of a corpus."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, bits: int = BITS):
        self.bits = bits
        pairs, single = np.zeros(2 << bits), np.zeros(POINTS)
        pairs[cells[cells >= 0]] = n[cells >= 0]
        single[-1 - cells[cells < 0]] = n[cells < 0]
        total = max(1.0, float(pairs[: 1 << bits].sum()))
        self.known = np.float32(np.log(max(LEAST, SUPPORT * total) + 0.1))
        self.total = np.float32(np.log(total))
        self.pairs, self.logs = np.log(pairs + 0.1).astype(np.float32), np.log(single + 1.0).astype(np.float32)

    def scores(self, p: np.ndarray) -> np.ndarray:
        """Mutual information of each adjacent pair of ``p``, in nats; improbable without support."""
        one, two = _cells(p, self.bits)
        n, log = np.minimum(self.pairs[one], self.pairs[two]), self.logs[p]
        return np.where(n >= self.known, np.maximum(n + self.total - log[:-1] - log[1:], np.float32(-4.0)), np.float32(IMPROBABLE))


def fit(texts: DataFrame, bits: int = BITS) -> Model:
    """Count all of the single string column of ``texts``; what comes to the driver is bounded by the tables' size."""
    got = texts.mapInArrow(lambda batches: _count(batches, bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = got.column("cell").to_numpy(), got.column("n").to_numpy()
    taken = float(((cells >= 0) & (cells < 1 << bits)).sum()) / (1 << bits)
    if taken > FILLED and bits < MOST_BITS:
        distinct = -np.log1p(-min(taken, 1 - 1e-9)) * (1 << bits)  # linear counting
        return fit(texts, int(np.clip(np.ceil(np.log2(distinct / FILLED)), bits + 1, MOST_BITS)))
    return Model(cells, n, bits)


def _segments(p: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring runs [from, to) of characters, over lines joined by LF."""
    x = -score.astype(np.float64)
    plain = (p[:-1] < 128) & (p[1:] < 128)
    x[plain] = np.minimum(x[plain], 0.0) - 0.5  # two ASCII characters tell nothing
    x[(p[:-1] == 10) | (p[1:] == 10)] = -1e4
    c = np.concatenate([[0.0], np.cumsum(x)])
    rise = c - np.minimum.accumulate(c)
    up = rise[1:] > 0
    if not up.any():
        return []
    found, open_ = [], [(0, up)]
    while open_:
        at, up = open_.pop()
        edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8))) + at
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            part = c[a : b + 1] - np.minimum.accumulate(c[a : b + 1])
            k = int(part.argmax())
            if part[k] >= SEGMENT:
                found.append((a, a + k + 1))
                rest = c[a + k : b + 1]  # what comes after its highest point may hold further runs
                rest = (rest - np.minimum.accumulate(rest))[1:] > 0
                if rest.any():
                    open_.append((a + k, rest))
    return sorted(found)


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff61-\uff9f]")
_BAD = re.compile("[\x7f-\x9f\ufffd\ue000-\uf8ff]")


def _as_utf8(text: str, raw: str) -> tuple[str, int]:
    """``text`` with the valid multi-byte sequences of ``raw`` (its bytes as characters) read; how many characters they cover."""
    out, at, covered = [], 0, 0
    for m in _UTF8.finditer(raw):
        try:
            new = m.group().encode("latin_1").decode("utf_8")
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], new]
        at = m.end()
        covered += at - m.start()
    return "".join([*out, text[at:]]), covered


def _readings(text: str, tried: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, bool, tuple[str, str]]]:
    """Inverse mappings of ``text``: (reading, it is whole UTF-8, (wrong, right)); ``tried``: only these."""
    p = _points(text)
    high = (p > 127) & (p < 0x10000)
    n = int((high & (p != 0xA0) & ((p < 0x2000) | (p > 0x206F) | ((p >= 0x2010) & (p <= 0x2027)))).sum())  # blanks are no evidence
    out: dict[str, tuple[bool, tuple[str, str]]] = {}
    whole = False
    for wrong in dict.fromkeys(w for w, _ in tried) if tried else WRONG:
        if wrong in WIDE:
            if n >= 4 and not whole and _CJK.search(text):
                try:
                    out.setdefault(text.encode(wrong).decode("utf_8"), (True, (wrong, "utf_8")))
                except (UnicodeEncodeError, UnicodeDecodeError):
                    pass
            continue
        b = byte_table(wrong)[np.where(p < 0x10000, p, 0)]
        lost = int((b[high] < 0).sum())
        if lost * 3 > n:
            continue
        raw = np.where(b < 0, 256, b).astype(np.uint16).tobytes().decode("utf_16_le")
        if not tried or (wrong, "utf_8") in tried:
            new, covered = _as_utf8(text, raw)
            if covered:
                whole |= covered >= n
                out.setdefault(new, (covered >= n, (wrong, "utf_8")))
        if lost or n < 3 and not tried or whole:  # one or two signs are read as an earlier run of the line was
            continue
        data = raw.encode("latin_1")
        for right in RIGHT[1:]:
            if right == wrong or tried and (wrong, right) not in tried or right in WIDE and n < 4:
                continue
            for a, z in ((0, 0), (1, 0), (0, 1), (1, 1)) if right in WIDE else ((0, 0),):  # a character may be cut at the ends
                try:
                    new = data[a : len(data) - z].decode(right)
                except UnicodeDecodeError:
                    continue
                out.setdefault(text[:a] + new + text[len(text) - z :], (False, (wrong, right)))
                break
    return [(new, full, how) for new, (full, how) in out.items() if new != text and not _BAD.search(new) and (full or not whole)]


def _proper(c: str) -> bool:
    """A character that valid UTF-8 may well stand for, even where the corpus has not met it in this place."""
    return "\xa0" <= c <= "\u024f" or "\u2010" <= c <= "\u203a" or c in "\u20ac\u2122\ufeff"


def _judge(model: Model, left: str, old: str, news: list[str], right: str) -> list[tuple[float, float, bool]]:
    """Of each of ``news`` between its neighbours: mean score; the share of pairs with support among
    the high ones that it changes against ``old``; whether all its new characters are proper.
    """
    texts = [left + n.replace("\ufeff", "") + right for n in news]
    p = _points("\n".join(texts) + "\n")
    score = model.scores(p)
    high = p > 127
    out, at = [], 0
    for new, text in zip(news, texts):
        n = len(text)
        plain = new.replace("\ufeff", "")
        same = rest = 0
        most = min(len(old), len(plain))
        while same < most and old[same] == plain[same]:
            same += 1
        while rest < most - same and old[-1 - rest] == plain[-1 - rest]:
            rest += 1
        a, z = at + max(0, len(left) + same - 1), at + min(n - 1, len(left) + len(plain) - rest)
        part = score[a:z][high[a:z] | high[a + 1 : z + 1]]
        known = float((part != IMPROBABLE).mean()) if len(part) else 1.0
        out.append((float(score[at : at + n - 1].mean()) if n > 1 else 0.0, known, all(_proper(c) for c in new if c > "\x7f" and c not in old)))
        at += n + 1
    return out


def _repair(model: Model, left: str, run: str, right: str, hints: list[tuple[str, str]]) -> str | None:
    """The most probable reading of ``run`` between its neighbours, if one beats what is there.

    ``hints``: mappings that restored text of the same kind before; they are tried first, and one
    that gives well-supported text is taken.  Successful mappings are put in front of it.
    """
    best, floor, here = None, _judge(model, left, run, [run], right)[0][0], run
    for _ in range(DEPTH):
        top, under = None, None
        if here.isascii():
            break
        for tried in (tuple(hints), ()) if hints else ((),):
            found = _readings(here, tried)
            for (new, full, how), (value, known, proper) in zip(found, _judge(model, left, here, [f[0] for f in found], right) if found else []):
                if how[1] == "utf_8" and (proper or full):
                    good = value > floor + GAIN / 4 or known >= 0.5
                else:
                    good = known >= 0.6 and value > max(LIVE, floor + GAIN)
                if good and (top is None or value > top[0]):
                    top = (value, new, how, known)
                if full and how[1] == "utf_8" and under is None:
                    under = new
            if top is not None and (top[3] >= 0.75 or not tried):
                break
        if top is None:
            if under is None:
                break
            here = under  # whole UTF-8 that reads no better may be the outer of two layers
            continue
        floor, best = top[0], top[1]
        here = best
        settled = top[3] >= 0.9 and top[0] > LIVE
        if top[2] in hints:
            hints.remove(top[2])
        hints.insert(0, top[2])
        del hints[3:]
        if settled:
            break  # it reads well: another layer could only harm it
    return best


def _restore(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple, tuple[str | None, list[tuple[str, str]]]] = {}
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        rows, line_no, before, after, restorable = [], [], [], [], []
        kept = [(k, t) for k, t in enumerate(texts) if t]
        if kept:
            # a text's own LFs part its lines; an extra LF parts the texts
            joined = "\n".join(t for _, t in kept)
            p = _points(joined + "\n\n")
            ends = np.flatnonzero(p[:-1] == 10)
            starts = np.concatenate([[0], ends[:-1] + 1])
            owner = np.repeat([k for k, _ in kept], [t.count("\n") + 1 for _, t in kept])
            number = np.concatenate([np.arange(1, t.count("\n") + 2) for _, t in kept])
            hit: dict[int, list[tuple[int, int]]] = {}
            score = model.scores(p)
            for a, b in _segments(p, score):
                if (p[a:b] > 127).any():
                    hit.setdefault(int(np.searchsorted(starts, a, "right")) - 1, []).append((a, b))
            for line, runs in sorted(hit.items()):
                s, e = int(starts[line]), int(ends[line])
                hints: list[tuple[str, str]] = []  # mappings that restored an earlier run of the line
                old = joined[s:e]
                out, at, done = [], s, False
                for a, b in runs:
                    a, b = max(a, s), min(b, e)
                    key = (joined[max(s, a - 2) : a], joined[a:b], joined[b : min(e, b + 2)], *hints)
                    if key not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        own = list(hints)
                        memo[key] = _repair(model, *key[:3], own), own
                    new, hints = memo[key][0], list(memo[key][1])
                    out.append(joined[at:a])
                    out.append(new if new is not None else joined[a:b])
                    done |= new is not None
                    at = b
                new = "".join([*out, joined[at:e]])
                stray = any(c == "�" or "\x80" <= c <= "\x9f" and c != "\x85" for a, b in runs for c in joined[max(a, s) : min(b, e)])
                if done or stray:
                    rows.append(int(owner[line]))
                    line_no.append(int(number[line]))
                    before.append(old)
                    after.append(new if done else None)
                    restorable.append(done and not any(c == "�" or "\x80" <= c <= "\x9f" for c in new))
        taken = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*taken.columns[:-1], pa.array(line_no, pa.int32()), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(restorable, pa.bool_())],
            names=[*batch.schema.names[:-1], "_line", "garbled", "restored", "whole"],
        )


def find(texts: DataFrame, text: str, keep: list[str], model: Model | None = None) -> DataFrame:
    """One row per garbled line of ``texts``: ``keep``, ``_line`` (from 1, split at LF), ``garbled``,
    ``restored`` (null: nothing could be) and ``whole`` (no damage is left).
    """
    spark: SparkSession = texts.sparkSession
    model = model or fit(texts.select(F.col(text).cast("string")))
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    table = texts.select(*keep, F.col(text).cast("string").alias("_text")).where(F.col("_text").rlike(SUSPECT))
    fields = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "_line int, garbled string, restored string, whole boolean"])
    return table.mapInArrow(lambda batches: _restore(shared.value, batches), schema)
