"""Byte-level BPE: encoding in length-bucketed padded matrices, and decoding.

Every distinct pre-token that a worker has not met is a row of a padded matrix of ids, in the bucket of
its length. In each round, every row merges its leftmost pair of minimum rank: the pair's rank comes from
an open-addressing hash table, the row closes up by one column, and finished rows leave the matrix.
Pre-tokens beyond the longest bucket follow the same rule with a heap over a linked list, so one
endless "word" costs n log n instead of n squared.

Null and empty texts have no ids. Repeated rows and ties need no care: rows are independent. Kept columns may have any
names (see ``common``). Very long texts are walked ``WALK_WORDS`` pre-tokens at a time.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.llm.common import SLICE_ROWS, beside, map_texts, release_memory, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST_ROW = 256
CACHED_WORDS = 150_000
#: Texts are cut into pre-tokens this many characters at a time; longer texts are walked by an iterator.
CHUNK_CHARS, WALK_CHARS, WALK_WORDS = 500_000, 1_000_000, 100_000
NONE = np.int64(1) << 62


class Encoder:
    """Ranks, the hashed pair table and a bounded cache of encoded pre-tokens."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(self.tokens) + 1
        self.cache: dict[str, tuple[int, ...]] = {}
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    merged.append(rank)
        self.pairs = dict(zip(keys, merged, strict=True))
        self._table(np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64))

    def _table(self, keys: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, NONE, dtype=np.int64)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[left[free]]
            won = self.slots[at] == keys[left]
            self.values[at[won]] = merged[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NONE where it doesn't merge or one side is padding."""
        keys = a * self.width + b
        out = np.full(keys.shape, NONE, dtype=np.int64)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._home(keys[left])
        while len(left):
            slot = self.slots[at]
            hit = slot == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (slot >= 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def _rows(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """One bucket: a padded matrix, merged round by round."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, wide = len(words), int(lengths.max())
        ids = np.full((n, wide), -1, dtype=np.int64)
        filled = np.arange(wide) < lengths[:, None]
        ids[filled] = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, wide - 1)
        rows, done = np.arange(n), [()] * n
        column = np.arange(wide)
        while len(rows):
            at = rank.argmin(axis=1)  # the first of equals: the leftmost
            here = np.arange(len(rows))
            best = rank[here, at]
            over = best == NONE
            if over.any():
                for r, line, k in zip(rows[over].tolist(), ids[over].tolist(), lengths[over].tolist(), strict=True):
                    done[r] = tuple(line[:k])
                go = ~over
                rows, ids, rank, lengths, at, best = rows[go], ids[go], rank[go], lengths[go], at[go], best[go]
                if not len(rows):
                    break
                wide = int(lengths.max())
                ids, rank, column, here = ids[:, :wide], rank[:, : wide - 1], np.arange(wide), np.arange(len(rows))
            ids[here, at] = best
            take = column[None, : wide - 1] + (column[None, : wide - 1] > at[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            lengths = lengths - 1
            wide -= 1
            column = column[:wide]
            if wide < 2:
                rank = np.full((len(rows), 1), NONE, dtype=np.int64)
                ids = np.concatenate([ids, np.full((len(rows), 1), -1, dtype=np.int64)], axis=1)
                wide, column = 2, np.arange(2)
                continue
            rank = np.take_along_axis(rank, take[:, : wide - 1], axis=1)
            rank[here, np.minimum(at, wide - 2)] = NONE
            right = np.flatnonzero(at < wide - 1)
            rank[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])
        return done

    def _long(self, word: bytes) -> tuple[int, ...]:
        """The same rule for a very long row: a heap of (rank, position) over a linked list."""
        ids = self.single[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, width, pairs = len(ids), self.width, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] * width + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r * width + ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := pairs.get(ids[h] * width + r)) is not None:
                heapq.heappush(heap, (x, h))
        return tuple(x for x in ids if x >= 0)

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHED_WORDS:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words - self.cache.keys():
            raw = word.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[word] = (whole,)
            elif len(raw) > LONGEST_ROW:
                self.cache[word] = self._long(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((word, raw))
        for size, found in buckets.items():
            step = max(1, (1 << 19) >> size)
            for i in range(0, len(found), step):
                part = found[i : i + step]
                self.cache.update(zip((w for w, _ in part), self._rows([r for _, r in part]), strict=True))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out, i = [], 0
        while i < len(texts):
            if len(texts[i]) > WALK_CHARS:
                ids: list[int] = []
                walk = (m.group() for m in self.find.finditer(texts[i]))
                while words := list(islice(walk, WALK_WORDS)):
                    self._learn(set(words))
                    ids.extend(chain.from_iterable(map(self.cache.__getitem__, words)))
                out.append(ids)
                i += 1
                continue
            chars, cut = 0, []
            while i < len(texts) and len(texts[i]) <= WALK_CHARS and (not cut or chars + len(texts[i]) <= CHUNK_CHARS):
                chars += len(texts[i])
                cut.append(self.find.findall(texts[i]))
                i += 1
            self._learn(set().union(*cut))
            out.extend(list(chain.from_iterable(map(self.cache.__getitem__, words))) for words in cut)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode(
    docs: DataFrame,
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    text_col: str = "text",
    keep: list[str] | None = None,
    with_decoded: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``ids`` array<int> and ``n_tokens``; with_decoded adds the decoded bytes.

    ``vocabulary`` is the path of a rank file; it is read on the driver and sent to the executors once (its
    size is that of a vocabulary, about 1 MB).
    """
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.LongType(), False)]
    fields += [T.StructField("decoded", T.BinaryType(), False)] * with_decoded

    def start():
        encoder = _encoder(sent.value, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = encoder.encode_batch([t or "" for t in texts.to_pylist()])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            ends = np.concatenate([[0], np.cumsum(counts)])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), type=kind)
            return [lists, pa.array(counts)] + [pa.array(map(encoder.decode, ids), pa.binary())] * with_decoded

        return work

    return map_texts(docs, text_col, [c for c in docs.columns if c != text_col] if keep is None else keep, fields, start)


def decode(df: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids, by a join-free lookup in the vocabulary; null ids give null."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = (line.split() for line in f.read().splitlines() if line)
        by_id = {int(b): base64.b64decode(a) for a, b in ranks}
    sent = df.sparkSession.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id) + 1)])
    at = df.columns.index(ids_col)
    names = beside(df.columns, [out_col])
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, df.schema.fields, strict=True)] + [T.StructField(out_col, T.BinaryType())])

    def run(batches):
        tokens = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                made = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(made, pa.binary())], names=schema.names)
        release_memory()

    return df.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), keep=["doc_id"], with_decoded=True)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
