"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size are quantised to ``BITS`` bits each; documents are sorted by the index of their
cell on the Hilbert curve, and the order is cut into runs of equal counts. A shard so covers few values of every
dimension, and its files can be pruned by any of them.

Equal texts go to one cell, the first of those that their rows have; inside a cell, texts with most copies come first, then
order is by checksum, size, digest and doc_id. The sort is a range partitioning on the whole key, so a cell or a text that
holds a third of all rows is split among tasks. Global positions come from a written table of (partition, position) and
the partitions' counts. All of it is column expressions: the curve is a table of 2**(3 * BITS) cells, broadcast.

Law ``rows``: counts at most one apart. Equal texts are neighbours, so of their groups only those are split that one of the
cuts, which the law sets, falls into: one less than there are shards at most. Null texts have size 1 and checksum 0; null
metadata is value 0; repeated rows get places of their own. Other columns are read by ``write_shards`` alone, and may have
any names but shard and slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom.llm.common import Workspace, quoted, table

BITS, SHARDS = 5, 8


def curve_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve through the grid of 2**bits cells per axis."""
    x = [np.asarray(a, dtype=np.int64).copy() for a in axes]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # from the axes to the transposed index: undo the turns of each level
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> b) & 1)
    return out


def category(col: Column, bits: int = BITS) -> Column:
    """A cell for each value: by its MD5. Null is 0."""
    return F.coalesce(F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % (1 << bits), F.lit(0))


def magnitude(col: Column, bits: int = BITS) -> Column:
    """A cell for each power of two: the number of binary digits."""
    return F.least(F.length(F.bin(F.greatest(F.coalesce(col, F.lit(1)), F.lit(1)).cast("long"))), F.lit((1 << bits) - 1))


def cells(spark: SparkSession, dims: int, bits: int = BITS) -> DataFrame:
    """(cell, curve): the place on the curve of each cell, a cell being its axes' values in base 2**bits."""
    every = np.arange(1 << (dims * bits))
    at = curve_index([(every >> (bits * (dims - 1 - i))) & ((1 << bits) - 1) for i in range(dims)], bits)
    return spark.createDataFrame(list(zip(every.tolist(), at.tolist(), strict=True)), "cell int, curve long")


def assign(rows: DataFrame, axes: list[Column], same: str, order: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` plus curve, shard and slot: runs of the curve's order, counts at most one apart.

    ``same``: what rows of one group share, to stay together; ``order``: ties inside a cell.
    """
    spark = rows.sparkSession
    work = Workspace(spark, "hilbert")
    cell = sum((a.cast("int") * (1 << (bits * (len(axes) - 1 - i))) for i, a in enumerate(axes)), F.lit(0))
    rows = rows.withColumn("__cell", cell)
    rows = rows.join(F.broadcast(cells(spark, len(axes), bits).withColumnRenamed("cell", "__cell")), "__cell").drop("__cell")  # 2**(bits * axes) rows
    copies = rows.groupBy(same).agg(F.count("*").alias("__n"), F.min("curve").alias("__low")).where("__n > 1").withColumnRenamed(same, "__same")
    copies = work.keep(copies, "copies")  # a plain table: Spark can then split the join's hot group
    rows = rows.join(copies, F.col(same) == F.col("__same"), "left").withColumn("curve", F.coalesce("__low", "curve")).withColumn("__less", -F.coalesce("__n", F.lit(1)))
    keys = [F.col(c) for c in ("curve", "__less", *order)]
    rows = rows.drop("__same", "__low", "__n").repartitionByRange(*keys).sortWithinPartitions(*keys)
    done = work.keep(rows.withColumn("__at", F.monotonically_increasing_id()).drop("__less"), "ordered")  # the partition, then the place in it
    counts = sorted((r["part"], r["n"]) for r in done.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task
    before, total = [], 0
    for part, n in counts:
        before.append((part, total - (part << 33)))
        total += n
    small, more = divmod(total, shards)
    rank = F.col("__at") + F.col("__before")
    cut = more * (small + 1)
    shard = F.when(rank < cut, F.floor(rank / (small + 1))).otherwise(more + F.floor((rank - cut) / max(1, small)))
    first = F.col("shard") * small + F.least(F.col("shard"), F.lit(more))
    places = spark.createDataFrame(before, "__part long, __before long")
    placed = done.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(places), "__part").withColumn("shard", shard.cast("int")).withColumn("slot", (rank - first).cast("long"))
    return placed.drop("__part", "__at", "__before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of each document; with ``carry`` its row as well, as __doc."""
    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    size, check, digest = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary")), F.sha2(text.cast("binary"), 256)
    row = [F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__doc")] if carry else []
    rows = docs.select("doc_id", size.alias("size"), check.alias("text_crc32"), digest.alias("__digest"), category(F.col("lang")).alias("__a"), category(F.col("source")).alias("__b"), magnitude(size).alias("__c"), *row)
    placed = assign(rows, [F.col(c) for c in ("__a", "__b", "__c")], "__digest", ["text_crc32", "size", "__digest", "doc_id"], shards)
    return placed.drop("__a", "__b", "__c", "__digest")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, text_col: str = "text") -> None:
    """The documents as one folder per shard, in the order of the slots, each row once.

    Rows travel with their places, as doc_id may be null or repeated; where ``placed`` doesn't carry them, they are
    placed again into as many shards, by the same order.
    """
    if "__doc" not in placed.columns:
        last = placed.agg(F.max("shard")).first()[0]
        placed = shard_documents(docs, 1 if last is None else last + 1, text_col, carry=True)
    rows = placed.select("__doc.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
