"""Models: smoothed and quantised tables per language, from counts.

``header``  lang_index, lang, flags, docs, chars_total, tokens_total, avg_doc_len, bm25_k1, bm25_b, oov_logprob_q
``ngrams``  lang, section, key, cnt, q            the TOP_K of each n-gram section
``idf``     lang, key, idf_q                       for the same keys as the token section
``hists``   lang, section, bin, q                  every bin
``charpos`` lang, row_index, cp, slot, q           rows by code point of the 256 most frequent characters
``classes`` lang, a, b, q                          every pair
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.functions import quantize as Q
from langloom.operators.counts import Counts, train_counts
from langloom.workspace import new_path, written


@contextmanager
def group_limits(spark: SparkSession):
    """Lets Spark cut ranked groups on the map side up to the largest TOP_K while plans are made and run."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), 20_000)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def top_k(counts: DataFrame, k: int, by: Iterable[str] = ("lang", "section")) -> DataFrame:
    """The ``k`` greatest counts of each group; ties by key."""
    order = Window.partitionBy(*by).orderBy(F.desc("cnt"), "key")
    return counts.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def totals(counts: DataFrame) -> DataFrame:
    """(lang, section, total), 1 at least; before any truncation."""
    return counts.groupBy("lang", "section").agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))


def token_idf(keys: DataFrame, languages: int | None = None) -> DataFrame:
    """(key, df, idf): in how many of the run's languages a token occurs, and the idf of that."""
    n = keys.select("lang").distinct().count() if languages is None else languages
    found = keys.select("lang", "key").distinct().groupBy("key").agg(F.count("*").cast("int").alias("df"))
    d = F.col("df").cast("float")
    arg = (F.lit(float(n)).cast("float") - d + F.lit(0.5).cast("float")).cast("double") / (d + F.lit(0.5).cast("float")).cast("double")
    return found.withColumn("idf", F.ln((arg.cast("float") + F.lit(1.0).cast("float")).cast("double")).cast("float"))


@dataclass(frozen=True)
class Model:
    header: DataFrame
    ngrams: DataFrame
    idf: DataFrame
    hists: DataFrame
    charpos: DataFrame
    classes: DataFrame

    def save(self, path: str) -> None:
        """One Parquet table each, partitioned by language."""
        with group_limits(self.header.sparkSession):
            for f in fields(self):
                df = getattr(self, f.name)
                if f.name == "header":
                    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
                else:
                    df.repartition("lang").write.partitionBy("lang").mode("overwrite").parquet(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Model)})

    def written(self) -> Model:
        path = new_path(self.header.sparkSession, "model")
        self.save(path)
        return Model.load(self.header.sparkSession, path)

    def languages(self) -> list[str]:
        """Codes in order of their index. A row per language."""
        return [r["lang"] for r in self.header.orderBy("lang_index").select("lang").collect()]

    def find(self, code: str) -> Model | None:
        """The model of one language, or None."""
        if code not in self.languages():
            return None
        return self.only([code])

    def get(self, lang_index: int) -> Model:
        return self.only([self.languages()[lang_index]])

    def only(self, codes: list[str]) -> Model:
        """Some languages, indexed in the order given."""
        order = self.header.sparkSession.createDataFrame(list(enumerate(codes)), "lang_index int, lang string")
        header = self.header.drop("lang_index").join(F.broadcast(order), "lang").select("lang_index", *[c for c in self.header.columns if c != "lang_index"])
        return Model(header, *[getattr(self, f.name).where(F.col("lang").isin(codes)) for f in fields(self)[1:]])

    def __len__(self) -> int:
        return self.header.count()


def candidates(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, the counts without n-grams that are rarer than the last one that a model keeps of their group), both written.

    The least count to keep follows from how many n-grams have each count, so only what is kept, and ties of the last, is ever sorted.
    """
    sizes = written(counts.groupBy("lang", "section", "cnt").agg(F.count("*").alias("n")), "sizes")
    total = sizes.groupBy("lang", "section").agg(F.greatest(F.sum(F.col("cnt") * F.col("n")), F.lit(1)).alias("total"))
    limit = F.create_map(*[F.lit(x) for s in K.NGRAM_SECTIONS for x in (s, K.TOP_K[s])])
    greater = F.sum("n").over(Window.partitionBy("lang", "section").orderBy(F.desc("cnt"))) - F.col("n")
    least = sizes.where(F.col("section").isin(*K.NGRAM_SECTIONS)).withColumn("__greater", greater).where(F.col("__greater") < limit[F.col("section")])
    least = least.groupBy("lang", "section").agg(F.min("cnt").alias("__least"))
    kept = counts.join(F.broadcast(least), ["lang", "section"], "left").where("__least IS NULL OR cnt >= __least").drop("__least")
    return written(total, "totals"), written(kept, "candidates")


def build_model(counts: Counts, languages: list[str] | None = None, max_docs: int = K.MAX_DOCS) -> Model:
    """``languages``: order of the indexes; by code if not given. A language below half of max_docs is marked."""
    spark = counts.counts.sparkSession
    if languages is None:
        languages = [r["lang"] for r in counts.stats.select("lang").orderBy("lang").collect()]  # a row per language
    index = F.broadcast(spark.createDataFrame(list(enumerate(languages)), "lang_index int, lang string"))
    total, every = candidates(counts.counts)
    total = F.broadcast(total)

    limit = F.create_map(*[F.lit(x) for s in K.NGRAM_SECTIONS for x in (s, K.TOP_K[s])])
    ngrams = every.where(F.col("section").isin(*K.NGRAM_SECTIONS))
    order = Window.partitionBy("lang", "section").orderBy(F.desc("cnt"), "key")
    most = max(K.TOP_K.values())
    top = ngrams.select("lang", "section", "key", "cnt").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most)
    top = top.where(F.col("__k") <= limit[F.col("section")]).drop("__k")
    model = top.join(total, ["lang", "section"]).select("lang", "section", "key", "cnt", Q.logprob(Q.smoothed(F.col("cnt"), F.col("total"))).alias("q"))

    keys = top.where(F.col("section") == K.TOKEN_UNIGRAM).select("lang", "key")
    known = counts.token_keys().join(F.broadcast(keys.select("key").distinct()), "key", "left_semi")
    idf = keys.join(token_idf(known, len(languages)), "key", "left").select("lang", "key", Q.idf(F.coalesce("idf", F.lit(0.0).cast("float"))).alias("idf_q"))

    bins = [(K.WORD_LENGTH, K.WORD_BINS), (K.SENTENCE_LENGTH, K.SENTENCE_BINS)]
    bins = F.concat(*[F.array(*[F.struct(F.lit(s).alias("section"), F.lit(b).cast("long").alias("key")) for b in range(n)]) for s, n in bins])
    grid = index.select("lang", F.inline(bins))
    hists = every.where(F.col("section").isin(K.WORD_LENGTH, K.SENTENCE_LENGTH)).select("lang", "section", "key", "cnt")
    hists = grid.join(hists, ["lang", "section", "key"], "left").join(total, ["lang", "section"], "left")
    share = Q.ratio(F.coalesce("cnt", F.lit(0)), F.coalesce("total", F.lit(1)))
    hists = hists.select("lang", "section", F.col("key").cast("int").alias("bin"), Q.probability(share).alias("q"))

    frequent = top_k(every.where(F.col("section") == K.CHAR_UNIGRAM).select("lang", "section", "key", "cnt"), K.CHAR_POSITION_CHARS)
    rows = frequent.withColumn("row_index", F.row_number().over(Window.partitionBy("lang").orderBy("key")) - 1)
    rows = rows.select("lang", "row_index", F.col("key").alias("cp"), F.col("cnt").alias("ci"), F.explode(F.array(*map(F.lit, range(3)))).alias("slot"))
    at = every.where(F.col("section") == K.CHAR_POSITION).select("lang", F.col("key").alias("cp"), F.col("sub").alias("slot"), "cnt")
    charpos = rows.join(at, ["lang", "cp", "slot"], "left")
    charpos = charpos.select("lang", "row_index", "cp", "slot", Q.logprob(Q.smoothed(F.coalesce("cnt", F.lit(0)), F.col("ci"), bottom=1.5)).alias("q"))

    cells = F.explode(F.sequence(F.lit(0), F.lit(K.CLASSES**2 - 1))).alias("cell")
    grid = index.select("lang", cells).selectExpr("lang", f"cast(cell DIV {K.CLASSES} AS int) AS a", f"cell % {K.CLASSES} AS b")
    seen = every.where(F.col("section") == K.CLASS_PAIR).select("lang", F.col("key").cast("int").alias("a"), F.col("sub").alias("b"), "cnt")
    grid = grid.join(seen, ["lang", "a", "b"], "left")
    of_row = F.greatest(F.sum(F.coalesce("cnt", F.lit(0))).over(Window.partitionBy("lang", "a")), F.lit(1))
    classes = grid.select("lang", "a", "b", Q.probability(Q.smoothed(F.coalesce("cnt", F.lit(0)), of_row)).alias("q"))

    trigrams = total.where(F.col("section") == K.CHAR_TRIGRAM).select("lang", F.col("total").alias("t"))
    header = index.join(counts.stats, "lang", "left").join(trigrams, "lang", "left")
    docs = F.coalesce("docs", F.lit(0))
    header = header.select(
        "lang_index",
        "lang",
        F.when(docs < max_docs // 2, K.LOW_RESOURCE).otherwise(0).alias("flags"),
        docs.alias("docs"),
        F.coalesce("chars_total", F.lit(0)).alias("chars_total"),
        F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"),
        F.when(docs > 0, Q.ratio(F.col("tokens_total"), F.greatest(docs, F.lit(1)))).otherwise(F.lit(0.0).cast("float")).alias("avg_doc_len"),
        F.lit(K.BM25_K1).cast("float").alias("bm25_k1"),
        F.lit(K.BM25_B).cast("float").alias("bm25_b"),
        Q.logprob(Q.smoothed(F.lit(0), F.coalesce("t", F.lit(1)))).alias("oov_logprob_q"),
    )
    return Model(header, model, idf, hists, charpos, classes)


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None, max_docs: int = K.MAX_DOCS) -> Model:
    """The written model of a table of texts. train_counts() writes the counts, which every table of the model reads."""
    return build_model(train_counts(df, text_col, lang_col), languages, max_docs).written()
