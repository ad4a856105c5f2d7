"""Command line: train from a directory of <code>.parquet or <code>.txt or from listed datasets, or run a benchmark file."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.plans.jobs import run_benchmark, train_corpus
from langloom.session import tune
from langloom.shipping import ship
from langloom.sources.registry import resolve
from langloom.sources.text import SCAN_ORDER, read_corpus, read_listed_corpus
from langloom.workspace import delete


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="langloom", description=__doc__)
    p.add_argument("--langs", type=lambda s: [x for x in s.split(",") if x], default=[], help="codes, comma-separated; all by default")
    p.add_argument("--out-dir", default="./models")
    p.add_argument("--max-docs", type=int, default=K.MAX_DOCS)
    p.add_argument("--eval-docs", type=int, default=K.EVAL_DOCS)
    p.add_argument("--text-col", default="text")
    p.add_argument("--from-text", help="directory of the corpus, on any file system that Spark reads")
    p.add_argument("--corpus-root", help="directory of the built-in datasets, on any file system that Spark reads; its credentials are that file system's settings")
    p.add_argument("--cache-dir", help="where the listed texts are kept for the second pass; <out-dir>/.cache by default")
    p.add_argument("--no-cache", action="store_true", help="read the listed files anew for each pass")
    p.add_argument("--leave-files", action="store_true", help="leave what was cached")
    p.add_argument("--workers", type=int, help="partitions of shuffles")
    p.add_argument("--no-combined", action="store_true")
    p.add_argument("--benchmark")
    p.add_argument("--model")
    return p


def main(args: list[str] | None = None) -> None:
    o = parser().parse_args(args)
    spark = ship(tune(SparkSession.builder.appName("langloom").getOrCreate()))
    if o.benchmark:
        got = run_benchmark(spark, o.benchmark, o.model, o.out_dir)
        got["misses"].show(truncate=False)
        got["report"].show(truncate=False)
        print(f"{got['cases']} cases, {got['docs_per_second']:.0f} docs/s")
        return
    if not o.from_text and not o.corpus_root:
        raise SystemExit("--from-text or --corpus-root is needed")
    if o.workers:
        spark.conf.set("spark.sql.shuffle.partitions", str(o.workers))
    codes = resolve(o.langs)
    if o.from_text:
        report(read_corpus(spark, o.from_text, codes, o.text_col), codes, o)
        return
    corpus, cached = read_listed_corpus(spark, o.corpus_root, codes, o.text_col), None
    try:
        if not o.no_cache:
            cached = f"{(o.cache_dir or o.out_dir + '/.cache').rstrip('/')}/texts-{uuid.uuid4().hex[:12]}"
            corpus.write.parquet(cached)
            corpus = spark.read.schema(corpus.schema).parquet(cached)
        report(corpus, codes, o)
    finally:
        if cached and not o.leave_files:
            delete(spark, cached)


def report(corpus: DataFrame, codes: list[str], o: argparse.Namespace) -> None:
    _, found = train_corpus(corpus, SCAN_ORDER, codes, o.max_docs, o.eval_docs, o.out_dir, not o.no_combined)
    found.orderBy(F.col("lang_index").asc_nulls_last()).show(40, truncate=False)


if __name__ == "__main__":
    main()
