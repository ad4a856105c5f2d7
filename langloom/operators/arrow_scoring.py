"""The integer terms of ``scoring.terms`` by NumPy lookups in Arrow batches.

One pass over each text serves all languages, with no shuffle before the ranking. The model's arrays are broadcast: a row
a key with a column a language, so at most the model's record limits times its languages. Results equal those of the
DataFrame plan, which stays the reference for character properties (Java's Unicode tables there, those of the regex
library here).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom import constants as K
from langloom.functions.batches import Cutter, chunked_sizes, mix
from langloom.operators import scoring as S
from langloom.operators.model import Model
from langloom.session import spread

class Table:
    """Sorted keys and a row of values each; then a row for missing keys and one of zeros."""

    def __init__(self, rows: list, key: str, names: list[str], missing: list[int]):
        rows = sorted(rows, key=lambda r: r[key])
        self.keys = np.array([r[key] for r in rows] or [0], dtype=np.uint32)
        self.values = np.array([[r[n] for n in names] for r in rows] + [missing] * (2 - bool(rows)) + [[0] * len(missing)], dtype=np.int64)
        self.miss, self.zero = len(self.values) - 2, len(self.values) - 1
        upper = np.bincount(self.keys >> np.uint32(16), minlength=1 << 16)  # keys by their upper half
        self.first, self.most = np.concatenate([[0], np.cumsum(upper)]), int(upper.max())

    def find(self, wanted: np.ndarray) -> np.ndarray:
        at = self.first[wanted >> np.uint32(16)]
        if self.most > 8:  # code points, or keys that aren't spread
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            return np.where(self.keys[at] == wanted, at, self.miss)
        out = np.full(len(wanted), self.miss)
        for k in range(self.most):
            there = np.minimum(at + k, len(self.keys) - 1)
            np.copyto(out, there, where=self.keys[there] == wanted)
        return out


class Tables:
    """All probes of a model, gathered on the driver."""

    def __init__(self, model: Model):
        look = S.Lookup(model)
        self.langs, size = look.langs, len(look.langs)
        self.names = lambda n: [f"{n}_{i}" for i in range(size)]
        make = lambda df, n, missing: Table(df.collect(), f"{n}_key", [f"{n}_{i}" for i in range(size)], missing)
        ngram = lambda section, n: make(look.ngram(section, n), n, look.oov)
        self.uni, self.bi, self.tri = ngram(K.CHAR_UNIGRAM, "uni"), ngram(K.CHAR_BIGRAM, "bi"), ngram(K.CHAR_TRIGRAM, "tri")
        self.tok, self.tokbi, self.pre, self.suf = ngram(K.TOKEN_UNIGRAM, "tok"), ngram(K.TOKEN_BIGRAM, "tokbi"), ngram(K.PREFIX, "pre"), ngram(K.SUFFIX, "suf")
        self.idf = make(look.idf(), "idf", look.zero)
        self.first, self.last = make(look.positions(0, "pf"), "pf", look.oov), make(look.positions(2, "pl"), "pl", look.oov)
        self.words, self.sents = make(look.bins(K.WORD_LENGTH, "wl"), "wl", look.zero), make(look.bins(K.SENTENCE_LENGTH, "sl"), "sl", look.zero)
        grid = {r["a"] * K.CLASSES + r["b"]: [r[f"cls_{i}"] for i in range(size)] for r in look.classes().collect()}
        self.classes = np.array([grid.get(i, [0] * size) for i in range(K.CLASSES**2)] + [[0] * size], dtype=np.int64)
        del self.names


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring bounds."""
    return np.diff(np.append(0, np.cumsum(values))[bounds])


class Scorer:
    def __init__(self, tables: Tables):
        self.t, self.size, self.cutter = tables, len(tables.langs), Cutter()

    def terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts: a row of COUNTS a text, terms: texts x languages x TERMS) of texts that aren't empty."""
        t, n, size = self.t, len(texts), self.size
        cut = self.cutter.cut(texts)
        out = {name: np.zeros((n, size), np.int64) for name in S.TERMS}

        a, b, c, number = cut.windows(K.SCORE_CHARS, True)
        one = a < cut.none
        two = one & (b < cut.none)
        three = two & (c < cut.none)
        h2, h3 = cut.hashes(a, b, c)
        kind = np.append(self.cutter.classes(cut.chars).astype(np.int64), 0)
        values = {
            "uni": t.uni.values[np.where(one, np.append(t.uni.find(cut.chars), 0)[a], t.uni.zero)],
            "bi": t.bi.values[np.where(two, t.bi.find(h2), t.bi.zero)],
            "tri": t.tri.values[np.where(three, t.tri.find(h3), t.tri.zero)],
            "cls": t.classes[np.where(two, kind[a] * K.CLASSES + kind[b], K.CLASSES**2)],
        }
        for high, low in (("uni", "bi"), ("tri", "cls")):  # sums of at most SCORE_CHARS numbers of 17 bits, so two fit into one
            for i in range(size):
                both = np.add.reduceat(((values[high][:, i] << 32) + values[low][:, i])[number], cut.start)
                out[low][:, i] = both.astype(np.int32)
                out[high][:, i] = (both - out[low][:, i]) >> 32

        by = np.append(np.searchsorted(cut.at, cut.start), len(cut.at))
        two = cut.size >= 2
        tok, idf = t.tok.find(cut.h), t.idf.find(cut.h)
        first, last = cut.f[cut.at], cut.f[cut.at + cut.head - 1]
        rows = lambda table, at, mask: table.values[np.where(mask, at, table.zero)]
        affix = rows(t.pre, t.pre.find(cut.pre), two) + rows(t.suf, t.suf.find(cut.suf), two)
        pos = rows(t.first, t.first.find(cut.chars)[first] if len(first) else first, two) + rows(t.last, t.last.find(cut.chars)[last] if len(last) else last, two)
        words = t.words.values[t.words.find(np.minimum(cut.size, K.WORD_BINS - 1).astype(np.uint32))]
        tok = t.tok.values[tok] * (t.idf.values[idf] + 4096)
        pair = cut.pairs()
        pairs = t.tokbi.values[t.tokbi.find(mix(cut.h[pair - 1], cut.h[pair]))]
        by_pair = np.append(np.searchsorted(cut.at[pair], cut.start), len(pair))
        end, run = cut.runs()
        sents = t.sents.values[t.sents.find(np.minimum(run, K.SENTENCE_BINS - 1).astype(np.uint32))]
        by_end = np.append(np.searchsorted(end, cut.start), len(end))
        for name, found, bounds in (("tok", tok, by), ("affix", affix, by), ("pos", pos, by), ("wl", words, by), ("tokbi", pairs, by_pair), ("sl", sents, by_end)):
            for i in range(size):
                out[name][:, i] = _sums(found[:, i], bounds)
        counts = np.stack([np.minimum(cut.length, K.SCORE_CHARS), np.diff(by), np.diff(by_pair), 2 * _sums(two.astype(np.int64), by), np.diff(by_end)], axis=1)
        return counts, np.stack([out[name] for name in S.TERMS], axis=2)


def terms(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As scoring.terms()."""
    return S.by_groups(model, lambda some: S.term_rows(by_text(docs, some, id_col, text_col), some))


def by_text(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """A row a text: doc_id, ``keep``, the counts, and ``terms``, the TERMS of each language in order. Nothing is shuffled."""
    tables = Tables(model)
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("__text")))
    longs = [T.StructField(c, T.LongType(), False) for c in S.COUNTS]
    each = T.StructType([T.StructField(c, T.LongType(), False) for c in S.TERMS])
    schema = T.StructType([*rows.schema.fields[:-1], *longs, T.StructField("terms", T.ArrayType(each, False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(sent.value)
            size, text = scorer.size, batch.column(batch.num_columns - 1)
            for i, j in chunked_sizes(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()):
                texts = [x or "" for x in text.slice(i, j - i).to_pylist()]
                some = [k for k, x in enumerate(texts) if x]
                counts, made = np.zeros((j - i, len(S.COUNTS)), np.int64), np.zeros((j - i, size, len(S.TERMS)), np.int64)
                if some:
                    counts[some], made[some] = scorer.terms([texts[k] for k in some])
                made = made.reshape(-1, len(S.TERMS))
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(made[:, c])) for c in range(len(S.TERMS))], fields=[pa.field(c, pa.int64(), False) for c in S.TERMS])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * size, size, dtype=np.int32)), structs, type=pa.list_(pa.field("element", structs.type, False)))
                kept = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.ascontiguousarray(counts[:, c])) for c in range(len(S.COUNTS))], lists], names=schema.names)

    return rows.mapInArrow(run, schema)
