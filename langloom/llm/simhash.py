"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts become 64-bit fingerprints of hashed word shingles. Two fingerprints within ``RADIUS`` bits have a
common neighbour within half of it of both, so every distinct fingerprint emits all variants in that half
ball, variants are shuffled, and fingerprints that meet at one variant are linked. Those that meet are all
within the radius of each other, so a bucket links each to the smallest: no pair inside a group is
spelled out, and no link between different fingerprints is lost for the components.

Equal fingerprints (copies) are merged before anything is emitted. Variants travel as packed arrays (eight
bytes and the number of the flipped mask) by the bucket of their hash, in rounds over disjoint parts of the
variant space, so that shuffle files of one round at most are on disk. Only distinct fingerprints and true
links leave a task.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share their
fingerprint. A null doc_id is never the name of a component unless no other is there. A very long text is hashed
``PIECE`` shingles at a time. Columns of ``deduplicate`` may have any names and come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from langloom.llm.common import Workspace, as_bytes, connected_components, map_texts, numbered, table

SHINGLE, RADIUS, SEED = 4, 4, 42
PIECE = 1 << 16  # shingles hashed at once: a long text costs little more than itself
CHUNK = 512  # fingerprints whose variants are made at once
BUCKET_ROWS = 1_000_000  # variants that meet in one task's memory
#: A round's variants take ROUND_BYTES, or more so that there are FEW_ROUNDS, up to CORE_BYTES a core of the cluster.
ROUND_BYTES, FEW_ROUNDS, CORE_BYTES = 64 << 20, 8, 1 << 30
MIX = np.uint64(0x9E3779B97F4A7C15)
SIMILARITY, BANDS, BAND_ROWS = 0.8, 25, 5
TURNS = np.random.default_rng(SEED).integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)  # one order of the hashes each
PAIRS_A_COPY, BROADCAST_ROWS, MOST_PIVOTS = 256, 500_000, 256


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; of the whole sequence if it is shorter than one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n, size = max(1, len(words) - shingle + 1), min(shingle, len(words))
    del words
    out = np.empty(n, dtype="<u8")
    for i in range(0, n, PIECE):
        j = min(n, i + PIECE)
        starts = ends[i - 1 : j - 1] + 1 if i else np.append(0, ends[: j - 1] + 1)
        cut = zip(starts.tolist(), ends[i + size - 1 : j + size - 1].tolist(), strict=True)
        out[i:j] = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in cut), np.uint64, j - i)
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as a signed number: bit i is set if it is in over half the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), PIECE):
        total += np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns plus ``fp``, the fingerprint as a signed long."""

    def start():
        return lambda texts: [pa.array(np.array([majority(shingle_hashes(t, shingle)) for t in as_bytes(texts)], dtype=np.int64))]

    return map_texts(docs, text_col, docs.columns if keep is None else keep, [T.StructField("fp", T.LongType(), False)], start)


def masks(radius: int) -> np.ndarray:
    """What to flip for each variant within ``radius`` bits: 1, 65 or 2081 masks for 0, 1 or 2."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    ball = {0}
    for _ in range(radius):
        ball |= {int(m ^ int(b)) for m in ball for b in bits}
    return np.array(sorted(ball), dtype=np.uint64)


def _variants(fps: DataFrame, half: int, rounds: int, turn: int, buckets: int) -> DataFrame:
    """Rows (bucket, variants, flips): packed variants of this turn's part of the space."""
    flips = masks(half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), CHUNK):
                made = (every[i : i + CHUNK, None] ^ flips[None, :]).ravel()
                mixed = (made * MIX) >> np.uint64(33)
                at = np.flatnonzero(mixed % np.uint64(rounds) == turn)
                bucket = ((mixed[at] // np.uint64(rounds)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                at, bucket = at[order], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(at) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(at))
                value, flip = made[at], (at % len(flips)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array([value[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([flip[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())],
                    names=["bucket", "variants", "flips"],
                )

    return fps.mapInArrow(run, "bucket int, variants binary, flips binary")


def _meet(parts: DataFrame, half: int) -> DataFrame:
    """Links (a, b) of fingerprints that share a variant, a the smallest of those that do."""
    flips = masks(half)

    def run(rows: pa.Table) -> pa.Table:
        value = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("variants").to_pylist()])
        flip = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("flips").to_pylist()])
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        at = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        value, own = value[at], value[at] ^ flips[flip[order[at]]]
        by = np.lexsort((own, value))
        value, own = value[by], own[by]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        low = np.repeat(own[first], np.diff(np.append(first, len(value))))
        near = (own != low) & (np.unpackbits((own ^ low).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= 2 * half)
        pairs = np.unique(np.stack([low[near], own[near]], axis=1).view(np.int64), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return parts.groupBy("bucket").applyInArrow(run, "a long, b long")


def links(work: Workspace, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of "within ``radius`` bits" over the distinct column ``fp``."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius is 0, 2 or 4")
    half, n = radius // 2, fps.count()
    emitted = n * len(masks(half))
    cores = max(1, fps.sparkSession.sparkContext.defaultParallelism)
    rounds = max(1, min(FEW_ROUNDS, -(-emitted * 10 // ROUND_BYTES)), -(-emitted * 10 // (cores * CORE_BYTES)))
    buckets = max(1, -(-emitted // rounds // BUCKET_ROWS))
    for turn in range(rounds):
        spread = fps.select("fp").repartition(max(1, -(-n // (4 * CHUNK))), "fp")
        found = _meet(_variants(spread, half, rounds, turn, buckets), half)
        found.write.mode("append").parquet(work.path("links"))
        work.release_shuffles()
    return work.spark.read.schema("a long, b long").parquet(work.path("links")).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable. No other column is read."""
    spark = docs.sparkSession
    work = Workspace(spark, "simhash")
    marked = work.keep(fingerprints(docs, text_col, ["doc_id"], shingle), "marked")
    distinct = work.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    joined = connected_components(work, links(work, distinct, radius))
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = work.keep(named.join(lowest, "c").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def bands(grams: np.ndarray) -> list[int]:
    """Band hashes of the set's minimum hashes: two sets of Jaccard 0.8 share none of them once in 20,000 pairs."""
    if not len(grams):
        return []
    low = np.full(len(TURNS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1024):
        np.minimum(low, (TURNS[:, None] * grams[None, i : i + 1024]).min(axis=1), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64).tolist()


def profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` plus fp (the fingerprint), grams (a name of the set of shingles) and bands (none for a text without words) of column ``text``."""

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            prints, names, hashed = [], [], []
            for text in as_bytes(texts):
                every = shingle_hashes(text, shingle)
                prints.append(majority(every))
                every = np.unique(every)
                names.append(xxh64_intdigest(every.tobytes(), SEED))
                hashed.append(bands(every))
            return [pa.array(np.array(prints, dtype=np.int64)), pa.array(np.array(names, dtype=np.uint64).view(np.int64)), pa.array(hashed, pa.list_(pa.int64()))]

        return work

    fields = [T.StructField("fp", T.LongType(), False), T.StructField("grams", T.LongType(), False), T.StructField("bands", T.ArrayType(T.LongType()), False)]
    return map_texts(docs, "text", docs.columns, fields, start)


def _verified(work: Workspace, pairs: DataFrame, marked: DataFrame, shingle: int, similarity: float, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) of sets whose Jaccard similarity is ``similarity`` or more, from the whole sets.

    A set that is compared to many others is copied, one copy for ``PAIRS_A_COPY`` of them, so no task gets all its pairs.
    """

    def start():
        return lambda texts: [pa.array([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in as_bytes(texts)], pa.list_(pa.int64()))]

    need = work.keep(pairs.selectExpr("a AS grams").union(pairs.selectExpr("b AS grams")).distinct(), f"{name}_need")
    wanted = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    one = marked.select("grams", "text").join(wanted, "grams", "left_semi").dropDuplicates(["grams"])
    sets = work.keep(map_texts(one, "text", ["grams"], [T.StructField("members", T.ArrayType(T.LongType()), False)], start), f"{name}_sets")
    hot = work.keep(pairs.groupBy("a").count().where(F.col("count") > PAIRS_A_COPY).select("a", F.ceil(F.col("count") / PAIRS_A_COPY).cast("int").alias("copies")), f"{name}_hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    copies = F.coalesce("copies", F.lit(1))
    left = sets.selectExpr("grams AS a", "members AS ma").join(hot, "a", "left").select("a", "ma", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    asked = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).cast("int").alias("copy"))
    both = asked.join(left, ["a", "copy"]).join(sets.selectExpr("grams AS b", "members AS mb"), "b")
    common = both.select("a", "b", F.size("ma").alias("na"), F.size("mb").alias("nb"), F.size(F.array_intersect("ma", "mb")).alias("n"))
    found = work.keep(common.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b"), f"{name}_found")
    for done in ("need", "sets", "hot"):
        work.drop(f"{name}_{done}")
    return found


def _components(work: Workspace, marked: DataFrame, near: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) over fingerprints: links ``near``, and any pair of texts of Jaccard ``similarity`` or more.

    Sets that share a band are candidates, bucket by bucket. Each turn compares all sets of a bucket that aren't yet of one
    component to its pivots, the smallest sets of as many parts of the bucket as the turn allows, and then leaves the pivots
    out; a bucket is done when what is left of it is of one component. So a turn makes rows in proportion to the buckets'
    sizes, and no pair of different components is missed.
    """
    sets = work.keep(marked.where("size(bands) > 0").groupBy("grams").agg(F.min("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
    prints = sets.select("grams", "fp")
    same = marked.where("size(bands) > 0").select("grams", F.col("fp").alias("other")).distinct().join(prints, "grams").where("fp <> other").selectExpr("fp AS a", "other AS b")
    edges = near.union(same)
    rows = work.keep(sets.select("grams", F.explode("bands").alias("bucket")), "bands")
    shared = rows.groupBy("bucket").agg(F.min("grams").alias("low"), F.max("grams").alias("high")).where("low <> high").select("bucket")
    left = work.keep(rows.join(shared, "bucket").select("bucket", "grams", F.lit(None).cast("long").alias("c")), "left0")
    work.drop("bands")
    a, b = prints.selectExpr("grams AS a", "fp AS fa"), prints.selectExpr("grams AS b", "fp AS fb")
    components, turn = None, 0
    while True:
        part = F.pmod(F.xxhash64("grams"), F.lit(min(MOST_PIVOTS, 16**turn)))
        pivots = left.groupBy("bucket", part.alias("part")).agg(F.min("grams").alias("pivot")).drop("part")
        pivots = work.keep(pivots.join(left.withColumnRenamed("grams", "pivot").withColumnRenamed("c", "pc"), ["bucket", "pivot"]) if turn else pivots.withColumn("pc", F.lit(None).cast("long")), f"pivots{turn}")
        pairs = left.join(pivots, "bucket").where("grams <> pivot AND (c IS NULL OR c <> pc)").selectExpr("least(pivot, grams) AS a", "greatest(pivot, grams) AS b")
        found = _verified(work, work.keep(pairs.distinct(), f"pairs{turn}"), marked, shingle, similarity, f"turn{turn}")
        if components is None or not found.isEmpty():
            more = found.join(a, "a").join(b, "b").where("fa <> fb").selectExpr("fa AS a", "fb AS b")
            known = edges if components is None else components.selectExpr("node AS a", "component AS b")  # stars: what is linked already takes few rounds
            components = work.keep(connected_components(work, known.unionAll(more)), f"components{turn}")
        named = prints.join(components, prints["fp"] == components["node"], "left").select("grams", F.coalesce("component", "fp").alias("c"))
        rest = left.drop("c").join(pivots.selectExpr("bucket", "pivot AS grams"), ["bucket", "grams"], "left_anti")
        placed = work.keep(rest.join(named, "grams").select("bucket", "grams", "c"), f"placed{turn}")
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
        turn += 1
        left = work.keep(placed.join(mixed, "bucket", "left_semi"), f"left{turn}")
        for done in ("left", "pivots", "pairs", "placed"):
            work.drop(f"{done}{turn - 1}")
        if left.isEmpty():
            return components


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, as they are: one of each component, that with the smallest doc_id.

    Linked are fingerprints within ``radius`` bits, and texts whose sets of shingles have a Jaccard similarity of
    ``similarity`` or more. A null doc_id comes after all others. Of rows of a component with one doc_id the one whose text
    has the smallest hash stays, of equal texts the first as read. A doc_id with texts of several components stays once for each.
    """
    work = Workspace(docs.sparkSession, "simhash")
    frame, own = numbered(docs, {"text": text_col, "id": id_col})
    frame = frame.withColumn("row", F.monotonically_increasing_id())
    marked = work.keep(profiles(frame, shingle), "marked")
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.xxhash64("text").alias("hash"), "row")
    distinct = work.keep(marked.select("fp", order.alias("o")).groupBy("fp").agg(F.min("o").alias("first")), "distinct")
    joined = _components(work, marked, links(work, distinct, radius), shingle, similarity)
    named = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    stays = named.groupBy("c").agg(F.min("first").alias("first")).select("c", F.col("first")["row"].alias("stays"))
    named = work.keep(named.join(stays, "c").select("fp", "stays"), "named")
    # written before it is joined: Spark can then split this join's hot fingerprints, whose rows nothing needs together
    gone = work.keep(marked.select("row", "fp").join(named, "fp").where("row <> stays").select("row"), "gone")
    return marked.join(gone, "row", "left_anti").select(*own)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
