"""Training counts by NumPy in Arrow batches: each text is read, folded and cut once for all sections.

Tokens are found, hashed and counted as arrays of code points, without a string each. A task keeps tables of what it has
counted, by language, and hands them on as (lang, section, key, sub, cnt) when they reach ``MOST_TOKENS``
tokens or ``MOST_KEYS`` keys, and at its end.
Memory so depends on neither the task's share of the corpus nor on its vocabulary; Spark sums the tables by key. Results equal those of
``counts.counts_by_columns``, but for characters that Java's Unicode tables and those of the regex library class otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.functions.batches import Cutter, chunked_sizes, mix, numbered

DOCUMENTS = -1  # section of the number of documents
MOST_TOKENS, MOST_KEYS = 1_000_000, 4_000_000
SCHEMA = "lang string, section int, key long, sub int, cnt long"
NAMES = ["lang", "section", "key", "sub", "cnt"]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


class Keys:
    """Counts by a whole number."""

    def __init__(self, kind: type = np.uint32):
        self.keys, self.counts, self.new, self.waiting = np.zeros(0, kind), np.zeros(0, np.int64), [], 0

    def __len__(self) -> int:
        return len(self.keys) + self.waiting

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.new.append(np.unique(keys, return_counts=True) if counts is None else summed(keys, counts))
        self.waiting += len(self.new[-1][0])
        if self.waiting > max(1 << 18, len(self.keys)):
            self.settle()

    def settle(self) -> Keys:
        if self.new:
            self.keys, self.counts = summed(np.concatenate([self.keys, *(k for k, _ in self.new)]), np.concatenate([self.counts, *(c for _, c in self.new)]))
            self.new, self.waiting = [], 0
        return self


class Tally:
    """What one language has so far, by the keys of its sections."""

    def __init__(self):
        self.docs, self.keys = 0, {s: Keys() for s in (*K.NGRAM_SECTIONS, K.CHAR_POSITION)}
        self.classes, self.words, self.sentences = np.zeros((K.CLASSES + 1) ** 2, np.int64), np.zeros(K.WORD_BINS, np.int64), np.zeros(K.SENTENCE_BINS, np.int64)


class Counter:
    def __init__(self, limit: int = K.TRAIN_CHARS):
        self.limit, self.cutter, self.by_lang = limit, Cutter(), {}

    def full(self) -> bool:
        """Whether there are more than ``MOST_TOKENS`` tokens or ``MOST_KEYS`` keys; what waits to be summed counts, so memory has a bound."""
        tokens, every = [t.keys[K.TOKEN_UNIGRAM] for t in self.by_lang.values()], [k for t in self.by_lang.values() for k in t.keys.values()]
        if sum(map(len, tokens)) <= MOST_TOKENS and sum(map(len, every)) <= MOST_KEYS:
            return False
        return sum(len(k.settle()) for k in every) > MOST_KEYS // 2 or sum(map(len, tokens)) > MOST_TOKENS // 2

    def add(self, lang: str, texts: list[str]) -> None:
        """Counts texts that aren't empty."""
        t = self.by_lang.setdefault(lang, Tally())
        t.docs += len(texts)
        cut = self.cutter.cut(texts, self.limit)
        a, b, c, n = cut.windows()
        two = (a < cut.none) & (b < cut.none)
        three = two & (c < cut.none)
        h2, h3 = cut.hashes(a, b, c)
        t.keys[K.CHAR_UNIGRAM].add(cut.chars[a[a < cut.none]], n[a < cut.none])
        t.keys[K.CHAR_BIGRAM].add(h2[two], n[two])
        t.keys[K.CHAR_TRIGRAM].add(h3[three], n[three])
        cps, start, length = cut.original
        seen, number = numbered(cps)
        kind = self.cutter.classes(seen).astype(np.int64)[number]
        kind[start + length] = K.CLASSES
        t.classes += np.bincount(kind[:-1] * (K.CLASSES + 1) + kind[1:], minlength=len(t.classes))
        t.keys[K.TOKEN_UNIGRAM].add(cut.h)
        i = cut.pairs()
        t.keys[K.TOKEN_BIGRAM].add(mix(cut.h[i - 1], cut.h[i]))
        t.words += np.bincount(np.minimum(cut.size, K.WORD_BINS - 1), minlength=K.WORD_BINS)
        t.sentences += np.bincount(np.minimum(cut.runs()[1], K.SENTENCE_BINS - 1), minlength=K.SENTENCE_BINS)
        long = cut.size >= 2
        t.keys[K.PREFIX].add(cut.pre[long])
        t.keys[K.SUFFIX].add(cut.suf[long])
        at, head = cut.at[long], cut.head[long]
        places = [cut.f[at] * 4, cut.f[at + head - 1] * 4 + 2] + [cut.f[at[head > k + 1] + k] * 4 + 1 for k in range(1, 7)]
        n = np.bincount(np.concatenate(places))
        place = np.flatnonzero(n)
        t.keys[K.CHAR_POSITION].add(cut.chars[place >> 2] * np.uint32(4) + (place & 3).astype(np.uint32), n[place])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """All tables, which are then empty."""
        for lang, t in self.by_lang.items():
            yield _rows(lang, DOCUMENTS, np.zeros(1, np.int64), 0, np.array([t.docs]))
            for section, keys in t.keys.items():
                keys.settle()
                places = section == K.CHAR_POSITION
                yield _rows(lang, section, keys.keys >> 2 if places else keys.keys, keys.keys & 3 if places else 0, keys.counts)
            pairs = t.classes.reshape(K.CLASSES + 1, -1)[: K.CLASSES, : K.CLASSES].ravel()
            for section, n, width in ((K.CLASS_PAIR, pairs, K.CLASSES), (K.WORD_LENGTH, t.words, 1), (K.SENTENCE_LENGTH, t.sentences, 1)):
                cell = np.flatnonzero(n)
                yield _rows(lang, section, cell // width, cell % width, n[cell])
        self.by_lang = {}


def _rows(lang: str, section: int, keys: np.ndarray, subs: np.ndarray | int, counts: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    cols = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(np.full(n, section, np.int32)), pa.array(keys.astype(np.int64)), pa.array(np.broadcast_to(subs, n).astype(np.int32)), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language, together of a bounded size."""
    langs, rows = batch.column(0).to_pylist(), {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    size = pa.compute.binary_length(batch.column(1)).to_numpy()
    for lang, some in rows.items():
        for i, j in chunked_sizes(size[some].tolist()):
            yield lang, batch.column(1).take(pa.array(some[i:j])).to_pylist()


def count(texts: DataFrame, limit: int = K.TRAIN_CHARS) -> DataFrame:
    """(lang, section, key, sub, cnt) of ``texts`` (lang, text; neither null, no text empty), with the section DOCUMENTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(limit)
        for batch in batches:
            for lang, rows in _by_language(batch):
                counter.add(lang, rows)
                if counter.full():
                    yield from counter.flush()
        yield from counter.flush()

    return texts.select("lang", "text").mapInArrow(run, SCHEMA).groupBy("lang", "section", "key", "sub").agg(F.sum("cnt").alias("cnt"))


def document_frequencies(texts: DataFrame, limit: int = K.TRAIN_CHARS) -> DataFrame:
    """(lang, key, df): rows of each language that have the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, found = Cutter(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, keys in found.items():
                keys.settle()
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(keys.keys)), pa.array(keys.keys.astype(np.int64)), pa.array(keys.counts)], names=["lang", "key", "df"])
            found.clear()

        for batch in batches:
            for lang, rows in _by_language(batch):
                cut = cutter.cut(rows, limit)
                doc = (np.searchsorted(cut.start, cut.at, "right") - 1).astype(np.uint64)
                once = np.unique((doc << np.uint64(32)) | cut.h.astype(np.uint64))
                found.setdefault(lang, Keys()).add((once & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                if sum(map(len, found.values())) > MOST_KEYS:
                    yield from flush()
        yield from flush()

    return texts.select("lang", "text").mapInArrow(run, "lang string, key long, df long").groupBy("lang", "key").agg(F.sum("df").alias("df"))
