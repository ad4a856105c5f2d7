"""Benchmark decontamination: an Aho-Corasick automaton over the normalised test questions and answers.

Texts are lower-cased (A-Z) and cut into words; the automaton's letters are word numbers of the benchmark's vocabulary,
its keys all windows of ``WINDOW`` words (a shorter item is one key). Each text is cut and hashed once. Texts that have
a window's hash are scanned, once, by the automaton, which compares words, so a hash that two windows share decides
nothing. Hits come back as ranges of words, and as spans of the original text in code points.

A benchmark of up to ``WHOLE_WINDOWS`` windows is one automaton, built once a worker. Of a larger one, the automaton of a
slice of texts holds the windows whose hash is in one of them: no other can occur there. What is broadcast, and
what the driver gathers at once, is at most ``PASS_BYTES`` of items (and one item); benchmarks beyond it take several
passes, each written before the next one starts.

Null and empty texts have no words; an item without words has no window. An item that is repeated
counts once; one without item_id marks words but isn't listed. Very long texts are hashed block by block. Kept columns
may have any names (see ``common``).
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import SLICE_ROWS, Workspace, as_bytes, beside, quoted, release_memory, table
from langloom.llm.tokens import chunks, mix, tokenize

WINDOW = 10
PASS_BYTES, WHOLE_WINDOWS = 64 << 20, 100_000
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and turns what parts words into a space.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 if b < 128 else b for b in range(256))
STEP = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= STEP
        out += words[k : k + n]
    return mix(out)


class Automaton:
    """Keys are windows of words, with the items that have them."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str | None]]):
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in windows.items():
            self.machine.add_word(tuple([self.number.setdefault(w, len(self.number) + 1) for w in key]), (len(key), names))
        self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> list[tuple[int, int, set[str | None]]]:
        """(first word, end, items) of every occurrence."""
        get = self.number.get
        return [(end + 1 - n, end + 1, names) for end, (n, names) in self.machine.iter(tuple([get(w, 0) for w in words]))]


class Benchmark:
    """Items as word hashes, and their windows' hashes in order; the words themselves are cut again where they are needed."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.items, self.window = items, window
        hashes, where, widths, self.whole = [], [], set(), None
        for i, j in chunks([t for _, t in items]):
            words, first = tokenize([t.translate(FOLD) for _, t in items[i:j]])
            counts = np.diff(first)
            for width in np.unique(np.minimum(counts, window)).tolist():
                if not width:
                    continue
                widths.add(width)
                h = window_hashes(words, width)
                owner = np.repeat(np.arange(j - i), counts)[: len(h)]
                at = np.arange(len(h))
                fits = (np.minimum(counts, window)[owner] == width) & (at + width <= first[1:][owner])
                hashes.append(h[fits] + np.uint64(width))
                where.append(((owner[fits] + i).astype(np.int64) << 32) | (at[fits] - first[:-1][owner[fits]]))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.where = every[order], (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.widths = sorted(widths)

    def hit(self, words: np.ndarray) -> np.ndarray:
        """The hashes of windows that are among those of ``words``, once each."""
        found = [np.zeros(0, np.uint64)]
        for width in self.widths if len(self.hashes) else ():
            h = window_hashes(words, width) + np.uint64(width)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found.append(h[self.hashes[at] == h])
        return np.unique(np.concatenate(found))

    def windows(self, hashes: np.ndarray | None = None) -> dict[tuple[bytes, ...], set[str | None]]:
        """All windows with their items, or those of the ``hashes``."""
        if hashes is None:
            where = self.where
        else:
            a, b = np.searchsorted(self.hashes, hashes, side="left"), np.searchsorted(self.hashes, hashes, side="right")
            where = np.concatenate([self.where[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)] or [self.where[:0]])
        out: dict[tuple[bytes, ...], set[str | None]] = {}
        owner = -1
        for x in np.sort(where).tolist():
            if x >> 32 != owner:
                owner = x >> 32
                name, words = self.items[owner][0], words_of(self.items[owner][1])
            at = x & 0xFFFFFFFF
            out.setdefault(tuple(words[at : at + self.window]), set()).add(name)
        return out

    def automaton(self, hashes: np.ndarray) -> Automaton:
        if len(self.hashes) > WHOLE_WINDOWS:
            return Automaton(self.windows(hashes))
        if self.whole is None:
            self.whole = Automaton(self.windows())
        return self.whole


@lru_cache(maxsize=1)  # a worker has one pass at a time
def _benchmark(sent, window: int) -> Benchmark:
    return Benchmark(sent.value, window)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_hit", T.LongType(), False),
    T.StructField("hit_words", T.ArrayType(SPAN, False), False),
    T.StructField("hit_spans", T.ArrayType(SPAN, False), False),
    T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
]
_SPANS = pa.list_(pa.field("element", pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]), False))
_NAMES = pa.list_(pa.field("element", pa.string(), False))


def _scan(texts: list[bytes], benchmark: Benchmark, ranges: list[list[tuple[int, int]]], items: list[set[str | None]]) -> list[int]:
    """Adds what each text has of the benchmark to ``ranges`` and ``items``; the numbers of words."""
    counts, hits = [0] * len(texts), {}
    for i, j in chunks(texts):
        words, first = tokenize([t.translate(FOLD) for t in texts[i:j]])
        counts[i:j] = np.diff(first).tolist()
        if not len(benchmark.hit(words)):  # over all texts at once: a window across two of them is only one more candidate
            continue
        for k in range(j - i):
            found = benchmark.hit(words[first[k] : first[k + 1]])
            if len(found):
                hits[i + k] = found
    if hits:
        machine = benchmark.automaton(np.unique(np.concatenate(list(hits.values()))))
        for i in hits:
            for a, e, who in machine.scan(words_of(texts[i])):
                ranges[i].append((a, e))
                items[i] |= who
    return counts


def _spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words as code points of the text."""
    if not ranges:
        return []
    edges, out = sorted({w for r in ranges for w in (r[0], r[1] - 1)}), {}
    wanted = iter(edges)
    now = next(wanted)
    for k, m in enumerate(WORD.finditer(text.translate(LOWER).decode())):
        if k == now:
            out[k] = m.span()
            now = next(wanted, -1)
            if now < 0:
                break
    return [{"start": out[a][0], "end": out[e - 1][1]} for a, e in ranges]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", item_id_col: str = "item_id", window: int = WINDOW, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) plus n_words, n_hit, hit ranges (words), spans (code points), items."""
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    made = [f.name for f in FIELDS]
    names, at = beside(keep, made), len(keep)
    items = benchmark.select(F.col(quoted(item_id_col)).cast("string").alias("i"), F.col(quoted(item_text_col)).cast("string").cast("binary").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    own = [T.StructField(f"c{i}", docs.schema[c].dataType, docs.schema[c].nullable) for i, c in enumerate(keep)]
    schema = T.StructType(own + [T.StructField("text", T.StringType())] + FIELDS)
    out = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col(quoted(text_col)).cast("string").alias("text"))
    work = Workspace(spark, "decontam") if passes > 1 else None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k) if passes > 1 else items
        sent = spark.sparkContext.broadcast([(r["i"], bytes(r["t"])) for r in part.toLocalIterator()])  # PASS_BYTES at most, and an item

        def run(batches, sent=sent, first=k == 0):
            for whole in batches:
                for lo in range(0, whole.num_rows, SLICE_ROWS):
                    batch = whole.slice(lo, SLICE_ROWS)
                    texts = as_bytes(batch.column(at))
                    ranges = [[] if first else [(x["start"], x["end"]) for x in old] for old in ([()] * len(texts) if first else batch.column(at + 3).to_pylist())]
                    found = [set() if first else set(old) for old in ([()] * len(texts) if first else batch.column(at + 5).to_pylist())]
                    counts = _scan(texts, _benchmark(sent, window), ranges, found)
                    ranges = [merge(r) for r in ranges]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(i) for i in range(at + 1)]
                        + [
                            pa.array(counts, pa.int64()),
                            pa.array([sum(e - a for a, e in r) for r in ranges], pa.int64()),
                            pa.array([[{"start": a, "end": e} for a, e in r] for r in ranges], _SPANS),
                            pa.array([_spans(t, r) for t, r in zip(texts, ranges, strict=True)], _SPANS),
                            pa.array([sorted(x for x in i if x is not None) for i in found], _NAMES),
                        ],
                        names=schema.names,
                    )
            release_memory()

        out = out.mapInArrow(run, schema)
        if work:
            out = work.keep(out, f"pass{k}")
            sent.unpersist()
            if k:
                work.drop(f"pass{k - 1}")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *made)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr("n_hit > 0").alias("contaminated"),
    )
