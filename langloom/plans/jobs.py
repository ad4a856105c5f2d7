"""The training and benchmark jobs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.operators.evaluate import benchmark_misses, benchmark_report, held_out_report
from langloom.operators.model import Model, train
from langloom.operators.split import split_keys, with_split
from langloom.sources.cases import read_cases
from langloom.sources.modelfile import find_file, read_file, write_files
from langloom.workspace import written


def train_corpus(
    corpus: DataFrame, order: list[str], languages: list[str] | None = None, max_docs: int = K.MAX_DOCS, eval_docs: int = K.EVAL_DOCS, out_dir: str | None = None, bundle: bool = True
) -> tuple[Model, DataFrame]:
    """(model, held-out report) of (lang, text and what orders the scan): split, count, build, write, evaluate."""
    known = corpus.where("text IS NOT NULL AND text <> ''")
    parts = with_split(known, written(split_keys(known, order, max_docs, eval_docs), "split_keys"), order, eval_docs)
    if "doc_id" not in corpus.columns:
        parts = parts.withColumn("doc_id", F.monotonically_increasing_id())
    parts = written(parts, "split")
    model = train(parts.where("split = 'train'"), languages=languages, max_docs=max_docs)
    if out_dir:
        write_files(model, out_dir, bundle)
    return model, held_out_report(parts.where("split = 'eval'"), model)


def run_benchmark(spark: SparkSession, path: str, model_path: str | None = None, out_dir: str = "./models") -> dict:
    """report and misses as DataFrames, with cases, seconds and documents a second."""
    cases = written(read_cases(spark, path), "cases")
    n = cases.count()
    if not n:
        raise ValueError(f"no benchmark cases in {path}")
    model = read_file(spark, find_file(spark, out_dir, model_path)).written()
    began = time.time()
    report = written(benchmark_report(cases, model), "report")
    took = time.time() - began
    return {"cases": n, "languages": model.languages(), "report": report.orderBy(F.col("want").asc_nulls_last()), "misses": benchmark_misses(cases, model), "seconds": took, "docs_per_second": n / took}
