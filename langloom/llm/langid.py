"""Language ID by nearest centroids of TF-IDF n-gram vectors.

Texts become counts of hashed byte 2- and 3-grams of folded letters. Document frequencies come from all training
documents; a bounded sample per language (``SAMPLE`` rows, the smallest hashes of doc_id) is clustered into
``CENTROIDS`` unit vectors per language by spherical k-means. A text gets the language of the centroid with
the greatest cosine; one that is farther from it than nearly all of the language's sample is marked
``rejected`` but still named.

Null texts and texts without a letter are ``und`` with score 0. Without training documents, all are. Ties go to the
first language in order. Repeated rows are predicted alike. A very long text is counted ``PIECE`` bytes at a time. Kept columns
may have any names (see ``common``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import as_bytes, map_texts, quoted, release_memory, table

BITS = 14
SAMPLE, CENTROIDS, ROUNDS, PIECE = 400, 4, 12, 1 << 20
REJECT_QUANTILE = 0.001
LETTER = regex.compile(r"\p{L}")
#: Lower-cases A-Z; all other ASCII but letters is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's n-grams."""
    line = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    if len(line) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for lo in range(0, len(line) - 1, PIECE):
        a = np.frombuffer(line, dtype=np.uint8)[lo : lo + PIECE + 2].astype(np.uint32)  # two more, for the n-grams that begin in this piece
        two = a[:-1] | (a[1:] << np.uint32(8))
        three = two[:-1] | (a[2:] << np.uint32(16)) | np.uint32(1 << 24)
        at = (np.concatenate([two[:PIECE], three[:PIECE]]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        counts += np.bincount(at, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights."""
    v = (1 + np.log(counts)) * idf[found]
    return (v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket over all of ``docs``: each task counts its own, then counts are summed by bucket."""

    def run(batches):
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total[vector(text)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["bucket", "n"])
        release_memory()

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2**BITS rows at most
    got = {r["bucket"]: r["n"] for r in rows}
    return np.array([got.get(b, 0) for b in range(1 << BITS)], dtype=np.int64), got.get(-1, 0)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows: spherical k-means from farthest-first seeds."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].sum(axis=0)
                c[j] = m / max(1e-12, float(np.linalg.norm(m)))
    return c


class Model:
    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.langs, self.owner, self.centroids, self.idf, self.least = langs, owner, centroids, idf, least

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        if not self.langs or not LETTER.search(text.decode()):
            return "und", 0.0, True
        found, counts = vector(text)
        cos = self.centroids[found].T @ weigh(found, counts, self.idf)
        best = int(cos.argmax())
        score = float(min(1.0, max(0.0, cos[best])))
        return self.langs[self.owner[best]], score, score < self.least[self.owner[best]]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE) -> Model:
    """Learns from every row of ``docs`` with text and language; at most ``rows`` vectors per language are gathered."""
    known = docs.select("doc_id", F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(lang_col)).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    frequency, n = document_frequencies(known)
    idf = np.log((n + 1) / (frequency + 1)) + 1
    # of each language about twice as many ids as are needed pass a bound on the hash; they are few enough to be ranked in one task
    ids = known.where("doc_id IS NOT NULL").select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect()  # a row for each language
    bounds = [(r["lang"], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (2 * rows + 50) / r["n"])))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, bound long")
    few = ids.join(F.broadcast(bounds), "lang").where(F.xxhash64("doc_id") <= F.col("bound")).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("k", F.row_number().over(order)).where(f"k <= {rows}").select("doc_id").distinct()

    def run(batches):
        for batch in batches:
            got = [vector(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([f.astype(np.uint16).tobytes() for f, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())],
                names=["doc_id", "lang", "found", "counts"],
            )

    picked = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")
    sample = picked.mapInArrow(run, "doc_id long, lang string, found binary, counts binary").toArrow().to_pandas()
    sample = sample.sort_values(["lang", "doc_id"]).drop_duplicates(["lang", "doc_id"])
    langs, owner, centroids, least = [], [], [], []
    for lang, part in sample.groupby("lang", sort=True):
        x = np.zeros((len(part), 1 << BITS), dtype=np.float32)
        for i, (f, c) in enumerate(zip(part["found"], part["counts"], strict=True)):
            at = np.frombuffer(f, np.uint16)
            x[i, at] = weigh(at, np.frombuffer(c, np.uint32), idf)
        x = x[x.any(axis=1)]
        if len(x):
            c = cluster(x)
            owner += [len(langs)] * len(c)
            langs.append(str(lang))
            centroids.append(c)
            least.append(float(np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE)))
    every = np.ascontiguousarray(np.concatenate(centroids).T) if langs else np.zeros((1 << BITS, 0), np.float32)
    return Model(langs, np.array(owner, dtype=np.int64), every, idf, np.array(least))


FIELDS = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)]


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus lang_pred, score (cosine) and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors a language

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            got = [sent.value.predict(t) for t in as_bytes(texts)]
            return [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return work

    return map_texts(docs, text_col, docs.columns if keep is None else keep, FIELDS, start)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs.where(fold != 2))
    held = docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    return identify(held, model, keep=["doc_id", "held_out"])
