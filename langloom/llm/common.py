"""Shared plumbing of the corpus operators: tables, written intermediates, Arrow maps, components.

Columns of the input that an operator doesn't compute with travel under names of the operator's own, so they may have any
name. One whose name a computed column needs (in any case) comes out as ``<name>_input``, its values unchanged.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langloom.workspace import app_dir, delete

SLICE_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name as it must be written where dots and backticks are syntax."""
    return "`" + name.replace("`", "``") + "`"


def beside(columns: Sequence[str], made: Sequence[str]) -> list[str]:
    """The names that input columns have beside computed ones."""
    taken = {m.lower() for m in made}
    used, out = taken | {c.lower() for c in columns}, []
    for c in columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in used):
            name += "_input"
        used.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, own: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with the columns of ``own`` (new name: column) renamed and the others as c0, c1, ...; and what to select in the end.

    A column called text that isn't a string is sent beside its original, as a string.
    """
    known = {c: k for k, c in own.items() if k != "text" or docs.schema[c].dataType == T.StringType()}
    names = [known.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    frame = docs.select(*[F.col(quoted(c)).alias(n) for n, c in zip(names, docs.columns, strict=True)], *[F.col(quoted(c)).cast("string").alias(k) for k, c in own.items() if c not in known])
    return frame, [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


_open: list[list[Workspace]] = []


class Workspace:
    """Written intermediate tables of one operator run, in the shared folder.

    ``keep`` writes a frame and reads it back, which cuts its lineage: a lost executor costs a reread.
    ``drop`` removes what a later step no longer reads; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{app_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        for made in _open[-1:]:
            made.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        delete(self.spark, self.path(name) if name else self.root)

    def release_shuffles(self) -> None:
        """Lets Spark's cleaner delete shuffle files of frames that are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def scratch():
    """Drops the workspaces made inside when left, by when their frames must have been written elsewhere."""
    made: list[Workspace] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop()
        for work in made:
            work.drop()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: None


def release_memory() -> None:
    """Gives what a finished task no longer uses back to the system: workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _libc()(0)


def map_texts(
    docs: DataFrame,
    text_col: str,
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., Sequence[pa.Array]]],
    also: Column | None = None,
) -> DataFrame:
    """``keep`` columns of ``docs`` plus the columns computed from each Arrow batch of texts.

    ``start`` runs once per task and returns the batch function, which gets the texts and the values of ``also`` if given.
    """
    names = beside(keep, [f.name for f in fields])
    own = text_col in keep and docs.schema[text_col].dataType == T.StringType()  # else the text is sent beside them
    sent = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], *[F.col(quoted(text_col)).cast("string").alias("text")] * (not own), *([] if also is None else [also.alias("also")]))
    n, at = len(keep), list(keep).index(text_col) if own else len(keep)
    schema = T.StructType([T.StructField(name, docs.schema[c].dataType, docs.schema[c].nullable) for name, c in zip(names, keep, strict=True)] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or start()
            for i in range(0, batch.num_rows, SLICE_ROWS):  # what a batch makes is held a slice at a time
                part = batch.slice(i, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(n)] + list(work(part.column(at), *part.columns[n + (not own) :])), names=schema.names)
        work = None
        release_memory()

    return sent.mapInArrow(run, schema)


def connected_components(work: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds; each round is written to the shared folder. Hubs are
    pre-aggregated by ``min`` and their edges joined back, so no node's neighbours meet in one task's memory.
    """
    now = work.keep(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "star0")
    before, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
        if before == tuple(mark) or not mark[0]:
            break
        before = tuple(mark)
        both = now.union(now.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct()
        large = work.keep(large, f"star{k}l")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v"))
        now = work.keep(small.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v").distinct(), f"star{k + 1}")
        work.drop(f"star{k}l")
        work.drop(f"star{k}")
        k += 1
    return now.selectExpr("u AS node", "v AS component").union(now.selectExpr("v AS node", "v AS component").distinct()).distinct()
