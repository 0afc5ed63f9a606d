"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: the frequent words of the whole corpus are compiled with their id sequences
into a minimal acyclic transducer (``lexicon``), which the executors map into memory;
words it does not hold go through exact merging by the public vocabulary's library.
The lexicon only decides how fast a word is answered, never what the answer is.

Defined results: null and empty texts give an empty list; special-token strings in a
text are ordinary text; a text of blanks gives the ids of its blanks.  Rows are never
joined or merged, so repeated rows come out repeated; a clashing column ``ids`` or
``n_tokens`` of the input is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remember, shared_path
from . import lexicon as lex
from . import vocab

LEXICON_WORDS = 50_000  # most frequent words that are compiled: bounds the lexicon file
LONGEST_WORD = 48  # bytes; longer words go to exact merging: bounds the lexicon file
MEMO_WORDS = 200_000  # words a worker remembers before it starts afresh


def _splitter():
    import regex

    return regex.compile(vocab.PATTERN).findall


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of the single string column of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = _splitter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) > MEMO_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encoder(name: str, folder: str | None):
    import tiktoken

    encoding = tiktoken.Encoding(name, pat_str=vocab.PATTERN, mergeable_ranks=vocab.ranks(name, folder), special_tokens={})
    return encoding.encode_ordinary


def build_lexicon(texts: DataFrame, words: int = LEXICON_WORDS, name: str = "byte_bpe_50k", folder: str | None = None) -> bytes:
    """Compile the ``words`` most frequent words of all of ``texts``.

    What comes to the driver is bounded by ``words`` times ``LONGEST_WORD`` bytes.
    """
    counts = word_counts(texts).where((F.octet_length("word") <= LONGEST_WORD) & (F.col("n") > 1))
    top = counts.orderBy(F.desc("n"), "word").limit(words).select("word").toArrow().column(0).to_pylist()
    encode = _encoder(name, folder)
    return lex.build({w.encode(): encode(w) for w in top})


def share(spark: SparkSession, blob: bytes) -> str:
    """Put a bounded file into the shared folder and have executors map it into memory: from there if it is
    mounted, else from the copy that each of them fetches.  Returns how :func:`_mapped` finds it.
    """
    path = shared_path(spark, "lexicon")
    remember(spark, path)
    if path.startswith("file:"):
        import os

        local = "/" + path[len("file:") :].lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(blob)
        return local
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(blob))
    stream.close()
    spark.sparkContext.addFile(path)
    return "fetched:" + path.rsplit("/", 1)[-1]


def _mapped(source: object) -> object:
    """The path (or, for a lexicon given as bytes, the bytes) of what :func:`share` put out."""
    if isinstance(source, str) and source.startswith("fetched:"):
        from pyspark import SparkFiles

        return SparkFiles.get(source[len("fetched:") :])
    return source if isinstance(source, (str, bytes)) else source.value


class Words:
    """Word -> ids for one worker: the mapped lexicon first, exact merging for the rest."""

    def __init__(self, source: object, name: str, folder: str | None):
        self.lexicon = lex.Lexicon(_mapped(source))
        self.name, self.folder, self.exact = name, folder, None
        self.slots: dict[str, int] = {}
        self.flat: list[int] = []
        self.start: list[int] = [0]

    def learn(self, words: list[str]) -> None:
        if len(self.slots) + len(words) > MEMO_WORDS and self.slots:
            self.slots, self.flat, self.start = {}, [], [0]
        numbers = self.lexicon.numbers([w.encode("utf-8", "surrogatepass") for w in words])
        for word, number in zip(words, numbers.tolist()):
            if number >= 0:
                ids = self.lexicon.outputs(number)
            else:
                if self.exact is None:
                    self.exact = _encoder(self.name, self.folder)
                ids = self.exact(word)
            self.slots[word] = len(self.slots)
            self.flat += ids
            self.start.append(len(self.flat))


def _encode(batches: Iterator[pa.RecordBatch], source: object, name: str, folder: str | None, count_only: bool) -> Iterator[pa.RecordBatch]:
    split, words = _splitter(), Words(source, name, folder)
    for batch in batches:
        pieces = [split(t) if t else () for t in batch.column(batch.num_columns - 1).to_pylist()]
        fresh = set().union(*pieces)
        if len(words.slots) + len(fresh) > MEMO_WORDS:
            words.learn(list(fresh))  # may start afresh, then all of the batch's words are known
        new = [w for w in fresh if w not in words.slots]
        if new:
            before = len(words.slots)
            words.learn(new)
            if len(words.slots) < before:
                words.learn([w for w in fresh if w not in words.slots])
        get = words.slots.__getitem__
        per_text = np.fromiter(map(len, pieces), np.int64, len(pieces))
        slots = np.fromiter((get(w) for p in pieces for w in p), np.int64, int(per_text.sum()))
        start, flat = np.asarray(words.start, np.int64), np.asarray(words.flat, np.int32)
        lengths = start[slots + 1] - start[slots]
        ends = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        bounds = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(per_text, out=bounds[1:])
        offsets = ends[bounds]
        keep = batch.columns[:-1]
        if count_only:
            out = pa.array(np.diff(offsets), pa.int64())
        else:
            where = np.repeat(start[slots] - ends[:-1], lengths) + np.arange(ends[-1])
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[where], pa.int32()))
        yield pa.RecordBatch.from_arrays([*keep, out], names=[*batch.schema.names[:-1], "n_tokens" if count_only else "ids"])


def _run(docs: DataFrame, text: str, keep: list[str], source: object, name: str, folder: str | None, count_only: bool) -> DataFrame:
    new = "n_tokens" if count_only else "ids"
    keep = [c for c in keep if c != new]
    table = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    fields = [f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "n_tokens long" if count_only else "ids array<int>"])
    return table.mapInArrow(lambda batches: _encode(batches, source, name, folder, count_only), schema)


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, *, lexicon: object = None, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default: all but the text) and ``ids``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if lexicon is None:
        lexicon = share(docs.sparkSession, build_lexicon(docs.select(text), name=name, folder=folder))
    return _run(docs, text, keep, lexicon, name, folder, False)


def token_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, *, lexicon: object = None, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """Like :func:`encode`, with only the number of ids, ``n_tokens``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if lexicon is None:
        lexicon = share(docs.sparkSession, build_lexicon(docs.select(text), name=name, folder=folder))
    return _run(docs, text, keep, lexicon, name, folder, True)
