"""Document cap and strided held-out split, in closed form instead of a sequential scan.

Only keys are ordered, never texts: by a range partitioning on language and key, so a language that has most of the rows is
split among tasks. A key's position follows from its place in its partition and from how many keys of its language
the partitions before it hold. Rows get their part of a split from the language's last key and its held-out ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.workspace import written

MOST_BROADCAST = 10_000  # held-out keys of a language


def positions(df: DataFrame, order: list[str], limit: int, lang_col: str = "lang") -> DataFrame:
    """(lang, order…, position): the first ``limit`` keys of each language, from 1. ``order`` must be total and not null."""
    keys = [lang_col, *order]
    ranked = written(df.select(*keys), "keys").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    ranked = written(ranked, "positions")  # __at is the partition and the place in it
    part = F.shiftright("__at", 33)
    held = ranked.groupBy(lang_col, part.alias("part")).agg(F.min("__at").alias("first"), F.count("*").alias("n")).collect()  # a row for each task and language in it
    before, rows = {}, []
    for r in sorted(held, key=lambda r: r["part"]):
        so_far = before.get(r[lang_col], 0)
        rows.append((r[lang_col], r["part"], so_far + 1 - r["first"]))
        before[r[lang_col]] = so_far + r["n"]
    shifts = df.sparkSession.createDataFrame(rows, "__lang string, __part long, __shift long")
    placed = ranked.join(F.broadcast(shifts), (F.col(lang_col) == F.col("__lang")) & (part == F.col("__part")))
    return placed.select(*keys, (F.col("__at") + F.col("__shift")).alias("position")).where(F.col("position") <= limit)


def split_keys(df: DataFrame, order: list[str], max_docs: int = K.MAX_DOCS, eval_docs: int = K.EVAL_DOCS, lang_col: str = "lang") -> DataFrame:
    """(lang, order…, position, split) of the rows that a scan in ``order`` reaches: ``split`` is train or eval, ``position`` 1 first.

    Each stride-th document of a language is held out until there are ``eval_docs``; those don't count to the cap of
    ``max_docs`` training documents, at which the scan ends.
    """
    stride = max(1, max_docs // max(1, eval_docs))
    i = F.col("position")
    trained_before = (i - 1) - F.least(F.floor((i - 1) / stride), F.lit(eval_docs))
    held = (i % stride == 0) & (F.floor(i / stride) <= eval_docs)
    reached = positions(df, order, max_docs + eval_docs, lang_col).where(trained_before < max_docs)
    return reached.withColumn("split", F.when(held, "eval").otherwise("train"))


def with_split(df: DataFrame, keys: DataFrame, order: list[str], eval_docs: int = K.EVAL_DOCS, lang_col: str = "lang") -> DataFrame:
    """Rows of ``df`` that are among the ``keys`` of its split, with ``split``.

    The keys are the first ones of each language, so its last one and the held-out ones tell; both are broadcast, and no text is shuffled.
    """
    last = keys.groupBy(F.col(lang_col).alias("__lang")).agg(F.max(F.struct(*order)).alias("__last"))
    held = keys.where("split = 'eval'").select(lang_col, *order, "split")
    rows = df.join(F.broadcast(last), F.col(lang_col) == F.col("__lang")).where(F.struct(*order) <= F.col("__last"))
    rows = rows.join(F.broadcast(held) if eval_docs <= MOST_BROADCAST else held, [lang_col, *order], "left")
    return rows.select(*df.columns, F.coalesce("split", F.lit("train")).alias("split"))


def strided_split(df: DataFrame, order: list[str], max_docs: int = K.MAX_DOCS, eval_docs: int = K.EVAL_DOCS, lang_col: str = "lang") -> DataFrame:
    """Rows that the scan of split_keys() reaches, with ``split`` and ``position``. Rows are shuffled; with_split() does without."""
    rows = df.join(split_keys(df, order, max_docs, eval_docs, lang_col), [lang_col, *order])
    return rows.select(*df.columns, "position", "split")


def cap(df: DataFrame, order: list[str], max_docs: int, lang_col: str = "lang") -> DataFrame:
    """The first ``max_docs`` documents of each language."""
    return df.join(positions(df, order, max_docs, lang_col).drop("position"), [lang_col, *order], "left_semi")
