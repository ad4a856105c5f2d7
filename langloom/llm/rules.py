"""Quality rules: fixed base rules, and a hashed word and character n-gram logistic regression.

The regression's input is the mean over a text of hashed words and of hashed 4-byte n-grams. It is
trained on a bounded sample of labelled rows (``TRAIN_ROWS``, the smallest hashes of doc_id), its
probability is calibrated on a fifth of them, and texts are scored in Arrow batches against a fixed
threshold.

Null and empty texts have no words and fail the base rule. Without labels of both kinds the verdict
is the base rules' alone. Repeated rows are scored alike. Kept columns may have any names (see ``common``). A very long text
costs its words as Python objects.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import as_bytes, map_texts, quoted, table

SPACE = b" \t\n\x0b\x0c\r"
GONE = SPACE + bytes(range(0x80, 0xC0))  # with it, bytes left are code points of words
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BITS = 16
TRAIN_ROWS = 3000
THRESHOLD = 0.4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
POWERS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WINDOW)]


def repeated_words(words: list[bytes], marks: np.ndarray) -> int:
    """Words in windows that the text has twice or more. marks: a 32-bit hash of each word.

    Windows of which no hash repeats are distinct; those with a repeated hash are compared as they are.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (marks.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    key = mixed[:n] * POWERS[0]
    for k in range(1, WINDOW):
        key += mixed[k : k + n] * POWERS[k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    starts: dict[tuple[bytes, ...], list[int]] = {}
    for i in at.tolist():
        starts.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for found in starts.values():
        if len(found) > 1:
            where = np.array(found)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counters(text: bytes, words: list[bytes], marks: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text.translate(None, GONE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, marks),
    )


def grams(text: bytes) -> np.ndarray:
    """A bucket for each 4-byte n-gram."""
    if len(text) < 4:
        return np.zeros(0, dtype=np.uint32)
    key = np.zeros(len(text) - 3, dtype=np.uint32)
    for k in range(4):
        key |= np.frombuffer(text, dtype=np.uint8)[k : k + len(key)].astype(np.uint32) << np.uint32(8 * k)
    key *= np.uint32(0x9E3779B1)
    key >>= np.uint32(32 - BITS)
    return key


def word_marks(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words))


class Model:
    """Weights of both feature blocks, the bias, and the two calibration constants."""

    def __init__(self, grams: np.ndarray, words: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.grams, self.words, self.bias, self.slope, self.shift = grams, words, bias, slope, shift

    def raw(self, text: bytes, marks: np.ndarray) -> float:
        out, g = self.bias, grams(text)
        if len(g):
            out += float(self.grams[g].mean())
        if len(marks):
            out += float(self.words[marks >> np.uint32(32 - BITS)].mean())
        return out

    def probability(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -40, 40))))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text_col: str = "text") -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents: the smallest hashes of doc_id, one row each."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so that it can be broadcast
    return docs.select("doc_id", F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


def _features(batches):
    for batch in batches:
        rows = []
        for text in as_bytes(batch.column("text")):
            g, gn = np.unique(grams(text), return_counts=True)
            w, wn = np.unique(word_marks(text.split()) >> np.uint32(32 - BITS), return_counts=True)
            at = np.concatenate([g, w.astype(np.uint32) + (1 << BITS)]).astype(np.uint32)
            weight = np.concatenate([gn / max(1, gn.sum()), wn / max(1, wn.sum())]).astype(np.float32)
            rows.append((at.tobytes(), weight.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("__label"), pa.array([a for a, _ in rows], pa.binary()), pa.array([b for _, b in rows], pa.binary())],
            names=["doc_id", "label", "at", "weight"],
        )


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 100, l2: float = 1e-6) -> Model:
    """Full-batch logistic regression (Adam), then Platt calibration on each fifth row. ``x`` is used up."""
    size = 2 << BITS
    order = np.argsort(np.arange(len(y)) % 5 == 4, kind="stable")  # those held out come last
    x[:], y = [x[i] for i in order], y[order]
    learn = int((np.arange(len(y)) % 5 != 4).sum())
    counts = np.array([len(a) for a, _ in x])
    rows, some = np.repeat(np.arange(len(x)), counts), int(counts[:learn].sum())
    at, weight = np.concatenate([a for a, _ in x]).astype(np.int64), np.concatenate([b for _, b in x])
    x.clear()
    r, a, v, t = rows[:some], at[:some], weight[:some], y[:learn]
    scale = 1 / (1e-3 + np.sqrt(np.bincount(a, v * v, size) / max(1, learn)))
    w, bias, m1, m2, mb1, mb2 = np.zeros(size), 0.0, np.zeros(size), np.zeros(size), 0.0, 0.0
    balance = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    for k in range(1, rounds + 1):
        z = np.bincount(r, (w * scale)[a] * v, learn) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) * balance
        g, gb = np.bincount(a, e[r] * v, size) * scale + l2 * w, float(e.sum())
        m1, m2, mb1, mb2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
        step = 0.02 / (1 - 0.9**k)
        w -= step * m1 / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
        bias -= step * mb1 / (np.sqrt(mb2 / (1 - 0.99**k)) + 1e-9)
    w *= scale
    z = np.bincount(rows[some:] - learn, w[at[some:]] * weight[some:], len(y) - learn) + bias if learn < len(y) else np.zeros(0)
    slope, shift = platt(z, y[learn:]) if len(z) else (1.0, 0.0)
    w = w.astype(np.float32)
    return Model(w[: 1 << BITS], w[1 << BITS :], bias, slope, shift)


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that fit the probabilities to the labels: damped Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda a, b: float((np.logaddexp(0, a * z + b) - t * (a * z + b)).sum() + 0.5 * (a - 1) ** 2)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        d = p * (1 - p)
        ga, gb = ((p - t) * z).sum() + (a - 1), (p - t).sum()
        haa, hab, hbb = (d * z * z).sum() + 1, (d * z).sum(), d.sum() + 1e-9
        det = haa * hbb - hab * hab
        da, db, step = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > loss(a, b):
            step /= 2
        a, b = a - step * da, b - step * db
    return (a, b) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, text_col: str = "text") -> Model | None:
    """The model, or None if the labels don't have both values. Reads at most ``rows`` texts' hashed counts."""
    known = sample(docs, labels, label, rows, text_col)
    got = known.mapInArrow(_features, "doc_id long, label int, at binary, weight binary").toArrow().sort_by("doc_id")
    y = np.array(got.column("label").to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.float32)) for a, b in zip(got.column("at").to_pylist(), got.column("weight").to_pylist(), strict=True)]
    del got
    return fit(x, y)


FIELDS = [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
FIELDS += [T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False), T.StructField("probability", T.DoubleType(), False)]


def quality_rules(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default) plus the counters, ``base_failed``, ``kept`` and ``probability``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS weights, whatever the corpus

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            rows = []
            for text in as_bytes(texts):
                words = text.split()
                marks = word_marks(words)
                got = counters(text, words, marks)
                failed = got[0] < 20 or 100 * got[4] > 30 * got[0]
                p = sent.value.probability(sent.value.raw(text, marks)) if sent.value else 1.0
                rows.append((*got, failed, not failed and p >= threshold, p))
            cols = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            return [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()], strict=True)]

        return work

    return map_texts(docs, text_col, docs.columns if keep is None else keep, FIELDS, start)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model, keep=["doc_id"])


def base_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters and base verdict of every document, without the model."""
    return quality_rules(table(spark, sf_dir, "documents"), None, keep=["doc_id"]).select("doc_id", *[f.name for f in FIELDS[:6]])
