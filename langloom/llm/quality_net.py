"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Tokens (runs of letters and digits, or of other signs) fall into ``WORDS`` hashed buckets. Every bucket has a sparse
ternary index vector; a bucket's word vector is the sum of the index vectors of its neighbours within two tokens
over all documents, unit length. A document is pooled to the mean and the spread of its tokens' vectors, with
the share of neighbours that are equal and of tokens that are new. A two-layer network is trained on a bounded
sample of labelled rows (``TRAIN_ROWS``), and its probabilities are calibrated by a temperature.

The corpus pass sums dense partial tables, whole numbers, by block of buckets in two levels, so no task holds more than its
share and the sums don't depend on the partitions. Null and empty texts pool to zeros and get the network's score for
that. Without labels of both kinds the score is the share of label 1, or 0.5. Repeated rows are scored alike. A very long
text is cut into tokens block by block, and its vectors are summed ``PIECE`` tokens at a time. Kept columns may have any names
(see ``common``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import as_bytes, map_texts, quoted, release_memory, table
from langloom.llm.rules import sample
from langloom.llm.tokens import BY_KIND, chunks, mix, tokenize

WORD_BITS, DIM, NONZERO, REACH = 15, 32, 4, 2
WORDS = 1 << WORD_BITS
BLOCKS, SPREAD, PIECE = 256, 32, 1 << 16
FEATURES = 2 * DIM + 3
TRAIN_ROWS, HIDDEN, EPOCHS = 6000, 32, 60
THRESHOLD = 0.3


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token, first token of each text and the end)."""
    value, first = tokenize(texts, BY_KIND)
    return (value >> np.uint64(64 - WORD_BITS)).astype(np.int32), first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(dimension, sign) of each bucket's NONZERO entries."""
    seed = mix(np.arange(WORDS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(WORDS, NONZERO)
    return (seed % np.uint64(DIM)).astype(np.int64), np.where(seed >> np.uint64(63), 1.0, -1.0)


def accumulate(texts: list[bytes], into: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds each token's neighbours' index vectors to its row of ``into``."""
    every, first = buckets(texts)
    owners = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    for lo in range(0, len(every), PIECE):
        token, owner = every[lo : lo + PIECE + REACH], owners[lo : lo + PIECE + REACH]
        for reach in range(1, REACH + 1):
            both = np.flatnonzero(owner[reach:] == owner[:-reach])
            both = both[both < PIECE]
            left, right = token[both], token[both + reach]
            for a, b in ((left, right), (right, left)):
                into += np.bincount((a[:, None] * DIM + place[b]).ravel(), sign[b].ravel(), WORDS * DIM)


def packed(total: np.ndarray) -> bytes:
    """Whole numbers as 32 bits each if all fit, else 64."""
    return total.astype(np.int32 if np.abs(total).max(initial=0) < 1 << 31 else np.int64).tobytes()


def unpacked(sums: bytes) -> np.ndarray:
    size = WORDS * DIM // BLOCKS
    return np.frombuffer(sums, np.int32 if len(sums) == 4 * size else np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """WORDS x DIM unit vectors from all documents."""

    def run(batches):
        total = np.zeros(WORDS * DIM)
        place, sign = index_vectors()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, j in chunks(texts):
                accumulate(texts[i:j], total, place, sign)
        part = TaskContext.get().partitionId() % SPREAD
        blocks = total.reshape(BLOCKS, -1)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.array([packed(blocks[k]) for k in at], pa.binary())], names=["block", "part", "sums"])
        release_memory()

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(WORDS * DIM // BLOCKS, dtype=np.int64)
        for x in rows.column("sums").to_pylist():
            total += unpacked(x)
        return pa.table({"block": rows.column("block")[:1].cast(pa.int32()), "part": rows.column("part")[:1].cast(pa.int32()), "sums": pa.array([packed(total)], pa.binary())})

    schema = "block int, part int, sums binary"
    partial = docs.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, schema)
    summed = partial.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    out = np.zeros((BLOCKS, WORDS * DIM // BLOCKS), dtype=np.float32)
    for r in summed.toLocalIterator():  # BLOCKS rows, WORDS * DIM numbers
        out[r["block"]] = unpacked(bytes(r["sums"]))
    out = out.reshape(WORDS, DIM)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for i, j in chunks(texts, 4 * PIECE):
        token, first = buckets(texts[i:j])
        n = np.diff(first)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        if len(token) > 4 * PIECE:  # one long text
            out[i] = pool_long(token, vectors)
            continue
        v = vectors[token]
        count = n[some, None].astype(np.float32)
        mean = np.add.reduceat(v, first[:-1][some], axis=0) / count
        spread = np.sqrt(np.maximum(0, np.add.reduceat(v * v, first[:-1][some], axis=0) / count - mean * mean))
        owner = np.repeat(np.arange(j - i), n)
        again = np.append(False, (token[1:] == token[:-1]) & (owner[1:] == owner[:-1]))
        fresh = np.zeros(len(token), dtype=bool)
        fresh[np.unique(owner.astype(np.int64) * WORDS + token, return_index=True)[1]] = True
        out[i + some, :DIM], out[i + some, DIM : 2 * DIM] = mean, spread
        out[i + some, 2 * DIM] = np.add.reduceat(again, first[:-1][some], dtype=np.float32) / count[:, 0]
        out[i + some, 2 * DIM + 1] = np.add.reduceat(fresh, first[:-1][some], dtype=np.float32) / np.sqrt(count[:, 0])
        out[i + some, 2 * DIM + 2] = np.log1p(count[:, 0])
    return out


def pool_long(token: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """As ``pool``, for the tokens of one text."""
    n, total, squares = len(token), np.zeros(DIM), np.zeros(DIM)
    for lo in range(0, n, PIECE):
        v = vectors[token[lo : lo + PIECE]]
        total += v.sum(axis=0, dtype=np.float64)
        squares += (v * v).sum(axis=0, dtype=np.float64)
    mean = total / n
    again, fresh = np.count_nonzero(token[1:] == token[:-1]), np.count_nonzero(np.bincount(token, minlength=WORDS))
    return np.concatenate([mean, np.sqrt(np.maximum(0, squares / n - mean * mean)), [again / n, fresh / np.sqrt(n), np.log1p(n)]])


class Network:
    """tanh layer and logit over standardised features; probabilities at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        tx, ty, step = x[~held], y[~held].astype(float), 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 128)):
                bx, by = tx[part], ty[part]
                h = np.tanh(bx @ w[0] + w[1])
                e = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - by) / len(by)
                back = np.outer(e, w[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((bx.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ e + 1e-4 * w[2], e.sum(keepdims=True))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        z, t = self._logit(x[held]), y[held]
        if len(t):
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda g: np.logaddexp(0, np.where(t == 1, -z, z) / g).mean()))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -30, 30)))


class Constant:
    """Where labels teach nothing."""

    def __init__(self, value: float):
        self.value = value

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", rows: int = TRAIN_ROWS) -> Network | Constant:
    """``vectors``: a broadcast of word_vectors(). Gathers FEATURES numbers of at most ``rows`` labelled rows."""

    def run(batches):
        for batch in batches:
            x = pool(as_bytes(batch.column("text")), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    got = sample(docs, labels, label, rows).mapInArrow(run, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    y = np.array(got.column("label").to_pylist(), dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(b, np.float32) for b in got.column("x").to_pylist()]).astype(np.float64)
    return Network(x, y)


def classify(docs: DataFrame, vectors, network, text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default) plus ``score`` and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            score = sent.value.score(pool(as_bytes(texts), vectors.value).astype(np.float64))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return work

    return map_texts(docs, text_col, docs.columns if keep is None else keep, fields, start)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # WORDS x DIM, whatever the corpus
    network = train(docs, labels.where(fold != 0), vectors)
    held = docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out"))
    return classify(held, vectors, network, keep=["doc_id", "held_out"])
