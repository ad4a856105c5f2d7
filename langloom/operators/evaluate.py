"""Held-out accuracy and labelled benchmark reports, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from langloom.functions.text import snippet
from langloom.operators.model import Model
from langloom.operators.scoring import classify_top


def accuracy(top: DataFrame, want: DataFrame, languages: DataFrame) -> DataFrame:
    """lang_index, lang, ok, total; a row per language (0 of 0 for none held out) and one TOTAL (index null).

    Compares positions: ``want`` has doc_id and lang_index.
    """
    rows = want.select("doc_id", F.col("lang_index").alias("want_index")).join(top.select("doc_id", "lang_index"), "doc_id")
    per = rows.groupBy("want_index").agg(F.sum((F.col("want_index") == F.col("lang_index")).cast("long")).alias("ok"), F.count("*").alias("total"))
    each = languages.select("lang_index", "lang").join(per, F.col("lang_index") == F.col("want_index"), "left")
    each = each.select("lang_index", "lang", F.coalesce("ok", F.lit(0)).cast("long").alias("ok"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    every = each.groupBy().agg(F.sum("ok").alias("ok"), F.sum("total").alias("total"))
    return each.unionByName(every.select(F.lit(None).cast("int").alias("lang_index"), F.lit("TOTAL").alias("lang"), "ok", "total"))


def held_out_report(held: DataFrame, model: Model) -> DataFrame:
    """Accuracy over held-out rows (doc_id, lang, text)."""
    want = held.select("doc_id", "lang").join(F.broadcast(model.header.select("lang", "lang_index")), "lang")
    return accuracy(classify_top(held, model), want, model.header)


def _judged(cases: DataFrame, model: Model, *keep: str) -> DataFrame:
    """case_id, got, confidence, want and ``keep``, which stay in the row of the case: no text is shuffled."""
    top = classify_top(cases, model, "case_id", keep=["want", *keep])
    return top.select(F.col("doc_id").alias("case_id"), "want", F.coalesce("lang", F.lit("")).alias("got"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *keep)


def benchmark_report(cases: DataFrame, model: Model) -> DataFrame:
    """want, ok, total, avg_confidence over cases (case_id, want, text): per label in order, and overall (want null).

    Compares codes.
    """
    rows = _judged(cases, model).withColumn("ok", (F.col("got") == F.col("want")).cast("long"))
    return rows.rollup("want").agg(F.sum("ok").alias("ok"), F.count("*").alias("total"), F.avg("confidence").alias("avg_confidence")).orderBy(F.col("want").asc_nulls_last())


def benchmark_misses(cases: DataFrame, model: Model) -> DataFrame:
    rows = _judged(cases.withColumn("snippet", snippet(F.col("text"))), model, "snippet").where("got <> want")
    return rows.select("case_id", "want", "got", "confidence", "snippet")
