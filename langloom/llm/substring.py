"""Substring dedup by recompression.

Words of a document become names (64-bit hashes), and rounds of recompression shorten the sequence: runs of a word are
named by (word, length); then, ``ROUNDS`` times, each pair of neighbours whose names fall into the left and the
right half of the alphabet of that round is named by the pair. Names depend on content alone, so they are global without
a dictionary, and equal substrings get equal symbols inside. With each symbol goes the range of words that fixed it (its
own and the neighbours that kept it unmerged): if that range lies in a window, every other occurrence of the window
has the same symbol at the same place.

Spark rounds then work on names: (1) symbols of ``LEAST`` words or more that more than one document has; (2) the windows
all of whose symbols are such, and those that no symbol lies in, each by a 128-bit BLAKE2b digest of its words: symbols
only rule windows out, and the words decide; (3) the smallest document of each digest; (4) what smaller documents have
is taken out, as ranges of words. Copies of a whole text are settled by the text's SHA-256 and emit no windows. Nothing
is sampled or capped: a window that the symbols can't rule out is compared.

Windows are judged on the input. Null and empty texts have no words. Rows that repeat a doc_id don't take words
from each other; a row with a null doc_id neither gives nor loses words. A very long text is hashed block by block and
costs its words as Python objects; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from langloom.llm.common import SLICE_ROWS, Workspace, as_bytes, quoted, release_memory, table
from langloom.llm.tokens import chunks, mix, tokenize

WINDOW, ROUNDS, LEAST, STEP = 50, 7, 6, 1 << 17
SECOND = np.uint64(0xA0761D6478BD642F)


def recompress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(name, start, end, from, to) of the last round's symbols: words [start, end), fixed by [from, to).

    A symbol that a text's end helped to fix has a range beyond the text.
    """
    n = len(words)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(n, dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    length = (end - start).astype(np.uint64)
    name = np.where(length > 1, mix(words[start] * np.uint64(3) + length), words[start])
    owner = owner[start]
    low, high = start - 1, end + 1  # that a run is no longer is fixed by the words beside it
    for k in range(rounds):
        m = len(name)
        if m < 2:
            break
        right = (mix(name + np.uint64((k + 1) * int(SECOND) % (1 << 64))) >> np.uint64(63)).astype(bool)
        same = owner[1:] == owner[:-1]
        pair = np.zeros(m + 1, dtype=bool)  # pair[i]: i - 1 and i are merged
        pair[1:m] = same & ~right[:-1] & right[1:]
        alone = ~pair[:m] & ~pair[1:]
        # what stays alone was kept so by the neighbour on the side where it could have merged
        left_low = np.append(np.iinfo(np.int64).min >> 2, np.where(same, low[:-1], start[1:] - 1))
        right_high = np.append(np.where(same, high[1:], end[:-1] + 1), end[-1:] + 1)
        left_low[0] = start[0] - 1
        grown_low = np.where(alone & right, np.minimum(low, left_low), low)
        grown_high = np.where(alone & ~right, np.maximum(high, right_high), high)
        head = np.flatnonzero(~pair[:m])
        two = pair[head + 1]
        tail = head + two
        name = np.where(two, mix(name[head] * np.uint64(5) + mix(name[tail] + SECOND)), name[head])
        low = np.where(two, np.minimum(low[head], low[tail]), grown_low[head])
        high = np.where(two, np.maximum(high[head], high[tail]), grown_high[head])
        start, end, owner = start[head], end[tail], owner[head]
    return name, start, end, low, high


def window_names(words: list[bytes], at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A row of two longs for each window that starts at ``at``: BLAKE2b, 128 bits, of its words joined by spaces.

    Words hold no space, so windows with one name have the same words, but for a collision of that digest.
    """
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[at].tolist()
    return np.frombuffer(b"".join([blake2b(line[i:j], digest_size=16).digest() for i, j in zip(starts, ends[at + width - 1].tolist(), strict=True)]), np.int64).reshape(-1, 2)


def text_name(text: bytes) -> int:
    """As ``named`` has it in Spark."""
    return int(np.uint64(xxh64_intdigest(sha256(text).hexdigest(), 42)).view(np.int64))


def named(docs: DataFrame, text_col: str, id_col: str, *more: Column) -> DataFrame:
    """doc_id, text, and tag: the name of the text, from its SHA-256. A row is known by doc_id and tag; rows without doc_id are left out."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    known = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("text"), *more)
    return known.withColumn("tag", F.xxhash64(F.sha2(F.col("text").cast("binary"), 256)))


def anchors(known: DataFrame) -> DataFrame:
    """(name, doc_id, tag): the long symbols of each row of ``known``, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2))
            for i, j in chunks(texts):
                words, first = tokenize(texts[i:j])
                if len(words):
                    name, start, end, _, _ = recompress(words, first)
                    long = np.flatnonzero(end - start >= LEAST)
                    row = i + np.searchsorted(first, start[long], side="right") - 1
                    order = np.lexsort((name[long], row))
                    name, row = name[long][order], row[order]
                    new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))[: len(name)]
                    yield pa.RecordBatch.from_arrays([pa.array(name[new].view(np.int64)), pa.array(ids[row[new]]), pa.array(tags[row[new]])], names=["name", "doc_id", "tag"])
        release_memory()

    return known.select("doc_id", "tag", "text").mapInArrow(run, "name long, doc_id long, tag long")


def _covered_by(low: np.ndarray, high: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each word p < n: whether some [low, high) lies in [p, p + width)."""
    best = np.full(n + 1, -1, dtype=np.int64)
    inside = (high <= n) & (low >= 0)
    np.maximum.at(best, high[inside], low[inside])
    best = np.maximum.accumulate(best)
    p = np.arange(n)
    return best[np.minimum(p + width, n)] >= p


def candidate_windows(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """(h1, h2, doc_id, tag, at, target) of the windows that may repeat; ``at``: the first word.

    ``rows``: doc_id, tag, text, names (shared symbols), later (of each whether a smaller document has it), and copy
    (whether a smaller document has the whole text: it then needs no windows, as that one has them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts, copy = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_bytes(batch.column(2)), batch.column(5).to_pylist()
            names, later = batch.column(3), batch.column(4)
            for i, j in chunks(texts):
                if all(copy[i:j]):
                    continue
                words, first = tokenize(texts[i:j])
                n = len(words)
                if n < width:
                    continue
                name, start, end, low, high = recompress(words, first)
                long = end - start >= LEAST
                name, low, high, owner = name[long], low[long], high[long], np.searchsorted(first, start[long], side="right") - 1
                salt = mix(np.arange(j - i, dtype=np.uint64) + np.uint64(1))
                part, flags = names.slice(i, j - i), later.slice(i, j - i)
                size = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                flat, target = part.flatten().to_numpy().view(np.uint64), flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
                key, mine = flat ^ np.repeat(salt, size), name ^ salt[owner]
                shared, known = np.isin(mine, key), np.isin(mine, key[target])
                ends = np.repeat(first[1:], np.diff(first))
                doc = np.repeat(np.arange(j - i), np.diff(first))
                maybe = (np.arange(n) + width <= ends) & ~np.array(copy[i:j], dtype=bool)[doc] & ~_covered_by(low[~shared], high[~shared], n, width)
                at = np.flatnonzero(maybe)
                may = ~_covered_by(low[~known], high[~known], n, width)[at]
                if not len(at):
                    continue
                where, doc = at - first[doc[at]], doc[at]
                cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                    own = texts[i + doc[a]].split()
                    for c in range(a, b, STEP):
                        cut = where[c : min(b, c + STEP)]
                        h = window_names(own[cut[0] : cut[-1] + width], cut - cut[0], width)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(cut), ids[i + doc[a]])), pa.array(np.full(len(cut), tags[i + doc[a]])), pa.array(cut), pa.array(may[c : min(b, c + STEP)])],
                            names=["h1", "h2", "doc_id", "tag", "at", "target"],
                        )
        release_memory()

    return rows.select("doc_id", "tag", "text", "names", "later", "copy").mapInArrow(run, "h1 long, h2 long, doc_id long, tag long, at long, target boolean")


def repeated_windows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WINDOW) -> tuple[Workspace, DataFrame]:
    """(doc_id, tag, starts, ends, copy): the ranges that windows of smaller documents cover; whether one has the whole text."""
    work = Workspace(docs.sparkSession, "substring")
    known = named(docs, text_col, id_col)

    tags = work.keep(known.select("doc_id", "tag"), "tags")
    equal = work.keep(tags.groupBy("tag").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "equal")
    copies = work.keep(tags.join(equal, "tag").where("low < doc_id").select("doc_id", "tag").distinct(), "copies")
    work.drop("tags")

    symbols = work.keep(anchors(known), "anchors")
    shared = symbols.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    shared = work.keep(shared, "shared")
    marks = symbols.join(shared, "name").groupBy("doc_id", "tag").agg(F.collect_list("name").alias("names"), F.collect_list(F.col("low") < F.col("doc_id")).alias("later"))
    mine = copies.withColumn("copy", F.lit(True))
    about = work.keep(marks.join(mine, ["doc_id", "tag"], "full").select("doc_id", "tag", "names", "later", F.coalesce("copy", F.lit(False)).alias("copy")), "about")
    work.drop("anchors")
    work.drop("shared")
    work.release_shuffles()

    # a row has at most as many names as symbols, and rows are met once: what is hashed is bounded by the partition
    rows = known.join(about.hint("shuffle_hash"), ["doc_id", "tag"], "left")
    windows = work.keep(candidate_windows(rows, width), "windows")
    work.drop("about")
    work.release_shuffles()
    low = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    low = work.keep(low, "low")
    work.release_shuffles()
    found = windows.where("target").join(low, ["h1", "h2"]).where("low < doc_id").select("doc_id", "tag", "at")
    found = work.keep(ranges(found, width), "found")
    work.drop("windows")
    work.drop("low")
    work.release_shuffles()
    return work, found.join(mine, ["doc_id", "tag"], "full").select("doc_id", "tag", "starts", "ends", F.coalesce("copy", F.lit(False)).alias("copy"))


def ranges(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, tag, starts, ends): the windows of a row as ranges of words, those that touch joined."""
    rows = found.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("at")).alias("at"))
    begins = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + width))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > x + width))
    return rows.select("doc_id", "tag", begins.alias("starts"), F.transform(last, lambda x: x + width).alias("ends"))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left, joined by one space. A row for each of ``docs``, without its other columns."""
    _, found = repeated_windows(docs, text_col, id_col, width)
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    rows = rows.withColumn("tag", F.xxhash64(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    rows = rows.join(found.withColumnRenamed("doc_id", "__id").withColumnRenamed("tag", "__tag").hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("tag") == F.col("__tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch, out = whole.slice(lo, SLICE_ROWS), []
                for text, starts, ends, copy in zip(as_bytes(batch.column(1)), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    words = text.split()
                    n = len(words)
                    if copy and n >= width:
                        words = []
                    elif starts:
                        words = [w for a, b in zip([0, *ends], [*starts, n], strict=True) for w in words[a:b]]
                    out.append((n, n - len(words), b" ".join(words)))
                n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
        release_memory()

    sent = rows.select("doc_id", "text", "starts", "ends", "copy")
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")], T.StructField("kept", T.BinaryType())])
    return sent.mapInArrow(run, schema).withColumn("kept", F.col("kept").cast("string"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
