"""Scores of every language for every text.

``classify`` looks terms up in Arrow batches (``arrow_scoring``); ``terms`` are the same as column expressions: the model
is pivoted to one row per key with a column per language, OOV filled in, and broadcast, so a text's features are probed
once for all languages. Languages are taken ``GROUP`` at a time, each group over all texts, so what is broadcast is at most
the record limits (TOP_K) times GROUP rows of GROUP numbers, whatever the corpus and the number of languages. Terms are summed
as BIGINT by document, so results don't depend on partitioning; the weighted sum of eight terms comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.functions import chars, hashing
from langloom.functions import quantize as Q
from langloom.operators import features as X
from langloom.operators.model import Model
from langloom.session import spread

MOST_LANGUAGES, GROUP = 256, 32
TERMS = ("tri", "bi", "uni", "tok", "affix", "tokbi", "pos", "cls", "wl", "sl")


def _wide(rows: DataFrame, keys: Sequence[str], value: str, langs: list[str], fill: list[int], name: str) -> DataFrame:
    """``keys`` and one column ``name_i`` per language; a language without the key gets its fill."""
    cols = [F.coalesce(F.max(F.when(F.col("lang") == c, F.col(value))), F.lit(fill[i])).alias(f"{name}_{i}") for i, c in enumerate(langs)]
    return rows.groupBy(*keys).agg(*cols)


class Lookup:
    """The model's probes. Reads the header (a row per language) on the driver."""

    def __init__(self, model: Model):
        head = model.header.orderBy("lang_index").collect()
        self.langs, self.oov, self.model = [r["lang"] for r in head], [r["oov_logprob_q"] for r in head], model
        self.zero = [0] * len(head)

    def ngram(self, section: int, name: str) -> DataFrame:
        rows = self.model.ngrams.where(F.col("section") == section)
        return _wide(rows, ["key"], "q", self.langs, self.oov, name).withColumnRenamed("key", f"{name}_key")

    def idf(self) -> DataFrame:
        return _wide(self.model.idf, ["key"], "idf_q", self.langs, self.zero, "idf").withColumnRenamed("key", "idf_key")

    def classes(self) -> DataFrame:
        return _wide(self.model.classes, ["a", "b"], "q", self.langs, self.zero, "cls")

    def bins(self, section: int, name: str) -> DataFrame:
        rows = self.model.hists.where(F.col("section") == section)
        return _wide(rows, ["bin"], "q", self.langs, self.zero, name).withColumnRenamed("bin", f"{name}_key")

    def positions(self, slot: int, name: str) -> DataFrame:
        """By the character's rank among the unigram section's code points; that rank's row may be another character's."""
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("key")) - 1
        ranked = self.model.ngrams.where(F.col("section") == K.CHAR_UNIGRAM).select("lang", "key", rank.alias("row_index"))
        rows = ranked.join(self.model.charpos.where(F.col("slot") == slot), ["lang", "row_index"])
        return _wide(rows, ["key"], "q", self.langs, self.oov, name).withColumnRenamed("key", f"{name}_key")

    def value(self, name: str, i: int, fill: int) -> Column:
        return F.coalesce(F.col(f"{name}_{i}"), F.lit(fill)).cast("long")


def char_terms(docs: DataFrame, look: Lookup) -> DataFrame:
    """doc_id, n, and sums tri_i, bi_i, uni_i, cls_i of each language i."""
    rows = X.code_windows(docs, ["doc_id"], K.SCORE_CHARS)
    for key, name, section in (("u", "uni", K.CHAR_UNIGRAM), ("h2", "bi", K.CHAR_BIGRAM), ("h3", "tri", K.CHAR_TRIGRAM)):
        rows = rows.join(F.broadcast(look.ngram(section, name)), F.col(key) == F.col(f"{name}_key"), "left")
    classes = look.classes().withColumnsRenamed({"a": "cls_a", "b": "cls_b"})
    rows = rows.join(F.broadcast(classes), (F.col("k1") == F.col("cls_a")) & (F.col("k2") == F.col("cls_b")), "left")
    sums = [F.count("*").alias("n")]
    for i, oov in enumerate(look.oov):
        sums.append(F.sum(look.value("uni", i, oov)).alias(f"uni_{i}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("h2").isNotNull(), look.value("bi", i, oov))), F.lit(0)).alias(f"bi_{i}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("h3").isNotNull(), look.value("tri", i, oov))), F.lit(0)).alias(f"tri_{i}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("k2").isNotNull(), look.value("cls", i, 0))), F.lit(0)).alias(f"cls_{i}"))
    return rows.groupBy("doc_id").agg(*sums)


def token_terms(docs: DataFrame, look: Lookup) -> DataFrame:
    """doc_id, n_tok, n_tokbi, n_pos, n_sent, and sums tok_i, affix_i, tokbi_i, pos_i, wl_i, sl_i. Texts are cut once."""
    rows = X.hashed_pairs(X.cut_sentences(docs, ["doc_id"], None), ["doc_id"])
    p = F.col("p")
    size, (pre, suf) = F.size(p), X.hashed_affixes(p, F.col("th"))
    two = size >= 2
    rows = rows.select(
        "doc_id",
        "th",
        hashing.mix(F.col("ph"), F.col("th")).alias("bh"),
        F.when(two, pre).alias("ph"),
        F.when(two, suf).alias("sh"),
        F.when(two, F.get(p, F.lit(0))).alias("fc"),
        F.when(two, F.get(p, F.least(size, F.lit(8)) - 1)).alias("lc"),
        chars.length_bin(size, K.WORD_BINS).alias("wb"),
        F.when(F.col("run").isNotNull(), chars.length_bin(F.col("run"), K.SENTENCE_BINS)).alias("sb"),
    )
    probes = (
        ("th", "tok", look.ngram(K.TOKEN_UNIGRAM, "tok")), ("th", "idf", look.idf()), ("bh", "tokbi", look.ngram(K.TOKEN_BIGRAM, "tokbi")), ("ph", "pre", look.ngram(K.PREFIX, "pre")),
        ("sh", "suf", look.ngram(K.SUFFIX, "suf")), ("fc", "pf", look.positions(0, "pf")), ("lc", "pl", look.positions(2, "pl")), ("wb", "wl", look.bins(K.WORD_LENGTH, "wl")),
        ("sb", "sl", look.bins(K.SENTENCE_LENGTH, "sl")),
    )
    for key, name, table in probes:
        rows = rows.join(F.broadcast(table), F.col(key) == F.col(f"{name}_key"), "left")
    two, pair = F.col("ph").isNotNull(), F.col("bh").isNotNull()
    sums = [F.count("*").alias("n_tok"), F.count("bh").alias("n_tokbi"), (F.count("ph") * 2).alias("n_pos"), F.count("sb").alias("n_sent")]
    for i, oov in enumerate(look.oov):
        v = lambda name, fill, i=i: look.value(name, i, fill)
        none = F.lit(0).cast("long")
        sums.append(F.sum(v("tok", oov) * (v("idf", 0) + 4096)).alias(f"tok_{i}"))
        sums.append(F.sum(F.when(two, v("pre", oov) + v("suf", oov)).otherwise(none)).alias(f"affix_{i}"))
        sums.append(F.sum(F.when(pair, v("tokbi", oov)).otherwise(none)).alias(f"tokbi_{i}"))
        sums.append(F.sum(F.when(two, v("pf", oov) + v("pl", oov)).otherwise(none)).alias(f"pos_{i}"))
        sums.append(F.sum(v("wl", 0)).alias(f"wl_{i}"))
        sums.append(F.sum(v("sl", 0)).alias(f"sl_{i}"))
    return rows.groupBy("doc_id").agg(*sums)


COUNTS = ("n", "n_tok", "n_tokbi", "n_pos", "n_sent")


def by_groups(model: Model, make: Callable[[Model], DataFrame]) -> DataFrame:
    """The term rows that ``make`` gives for each ``GROUP`` of the model's languages, together."""
    langs = model.languages()
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if len(langs) <= GROUP:
        return make(model)
    rows = [make(model.only(langs[i : i + GROUP])).withColumn("lang_index", F.col("lang_index") + i) for i in range(0, len(langs), GROUP)]
    return reduce(DataFrame.unionByName, rows)


def terms(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text and language: doc_id, lang_index, lang, the counts and the integer TERMS.

    ``id_col`` must be unique. A null text counts as empty.
    """
    return by_groups(model, lambda some: term_rows(by_text(docs, some, id_col, text_col), some))


def term_rows(texts: DataFrame, model: Model) -> DataFrame:
    """A row for each text and language, of rows by text."""
    langs = F.array(*[F.lit(c) for c in model.languages()])
    rows = texts.select("doc_id", *COUNTS, F.posexplode("terms").alias("lang_index", "__t"))
    return rows.select("doc_id", *COUNTS, "lang_index", F.get(langs, F.col("lang_index")).alias("lang"), *[F.col(f"__t.{t}").alias(t) for t in TERMS])


def by_text(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a text: doc_id, the counts, and ``terms``, an array of the TERMS of each language in order."""
    look = Lookup(model)
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    some = texts.where("text <> ''")
    joined = texts.select("doc_id")
    for part in (char_terms(some, look), token_terms(some, look)):
        joined = joined.join(part, "doc_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    each = F.array(*[F.struct(*[zero(f"{t}_{i}").alias(t) for t in TERMS]) for i in range(len(look.langs))])
    return joined.select("doc_id", *[zero(c).alias(c) for c in COUNTS], each.alias("terms"))


def score(term_rows: DataFrame) -> DataFrame:
    """Adds ``score``: the weighted sum of the terms; minus infinity for an empty text."""
    return term_rows.withColumn("score", score_of(F.col))


def score_of(c: Callable[[str], Column]) -> Column:
    """The score by a text's counts and a language's terms, which ``c`` gives."""
    short = c("n") < K.SHORT_TEXT
    weight = lambda a, b: F.when(short, F.lit(a)).otherwise(F.lit(b))
    tokens = F.greatest(c("n_tok"), F.lit(1).cast("long"))
    token_sum = c("tok") / F.lit(4096.0) + F.lit(0.2) * c("affix")
    share = lambda total, n: F.ln(F.greatest(F.when(n == 0, F.lit(0.0)).otherwise(total / (F.lit(65535.0) * n)), F.lit(1e-6)))
    total = (
        Q.mean(c("tri"), F.greatest(c("n") - 2, F.lit(0).cast("long"))) * weight(0.55, 0.45)
        + Q.mean(c("bi"), F.greatest(c("n") - 1, F.lit(0).cast("long"))) * weight(0.30, 0.25)
        + Q.mean(c("uni"), c("n")) * F.lit(0.05)
        + token_sum / (F.lit(4096.0) * tokens) * weight(0.05, 0.15)
        + Q.mean(c("tokbi"), c("n_tokbi")) * F.lit(0.05)
        + Q.mean(c("pos"), c("n_pos")) * F.lit(0.03)
        + Q.mean(c("cls"), F.greatest(c("n") - 1, F.lit(0).cast("long"))) * F.lit(0.02)
        + (share(c("wl"), c("n_tok")) + share(c("sl"), c("n_sent"))) * F.lit(0.05)
    )
    return F.when(c("n") == 0, F.lit(float("-inf"))).otherwise(total).cast("float")


def rank_in_row(texts: DataFrame, langs: list[str], keep: Sequence[str] = (), max_out: int | None = None) -> DataFrame:
    """As rank(score(...)), of rows by text: no row leaves its partition and none is sorted among others."""
    rows = texts.withColumn("__s", F.transform("terms", lambda x: score_of(lambda name: x[name] if name in TERMS else F.col(name))))
    rows = rows.select("doc_id", *keep, "__s", F.array_max("__s").alias("__best"))
    e = F.transform("__s", lambda s: F.exp(F.greatest(F.least((s - F.col("__best")).cast("double") / K.TEMPERATURE, F.lit(0.0)), F.lit(-20.0))))
    rows = rows.withColumn("__e", F.when(F.col("__best") > float("-inf"), e))
    rows = rows.withColumn("__all", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
    order = F.array_sort(F.transform("__s", lambda s, i: F.struct((F.lit(0.0).cast("float") - s).alias("down"), i.alias("lang_index"), s.alias("score"))))
    rows = rows.withColumn("__o", order if max_out is None else F.slice(order, 1, max_out))
    rows = rows.select("doc_id", *keep, "__e", "__all", F.posexplode("__o").alias("__at", "__r"))
    i = F.col("__r.lang_index")
    confidence = F.coalesce(F.get(F.col("__e"), i) / F.col("__all"), F.lit(0.0)).cast("float")
    return rows.select("doc_id", i.alias("lang_index"), F.get(F.array(*map(F.lit, langs)), i).alias("lang"), F.col("__r.score").alias("score"), confidence.alias("confidence"), (F.col("__at") + 1).alias("rank"), *keep)


def rank(scored: DataFrame) -> DataFrame:
    """doc_id, lang_index, lang, score, confidence, rank. Ties go to the lower index.

    Confidence is a softmax at TEMPERATURE; all are 0 where the best score isn't finite.
    """
    of_doc = Window.partitionBy("doc_id")
    best = F.max("score").over(of_doc)
    e = F.exp(F.greatest(F.least((F.col("score") - best).cast("double") / K.TEMPERATURE, F.lit(0.0)), F.lit(-20.0)))
    rows = scored.withColumn("__best", best).withColumn("__e", F.when(F.col("__best") == float("-inf"), F.lit(0.0)).otherwise(e))
    rows = rows.withColumn("__all", F.sum("__e").over(of_doc))
    order = of_doc.orderBy(F.desc("score"), "lang_index")
    confidence = F.when(F.col("__all") > 0, F.col("__e") / F.col("__all")).otherwise(F.lit(0.0)).cast("float")
    return rows.select("doc_id", "lang_index", "lang", "score", confidence.alias("confidence"), F.row_number().over(order).alias("rank"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_out: int | None = None, by_columns: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Every language for every text, ranked; the first ``max_out`` if given. ``by_columns``: without Python workers.

    Up to ``GROUP`` languages are ranked in the row of the text. ``keep``: columns to hand on, under names that aren't of the result.
    """
    from langloom.operators import arrow_scoring  # which has by_text() of this module in Arrow batches

    if max_out is not None and max_out < 1:
        raise ValueError("max_out is 1 or more")
    langs = model.languages()
    if len(langs) <= GROUP:
        texts = by_text(docs, model, id_col, text_col) if by_columns else arrow_scoring.by_text(docs, model, id_col, text_col, keep)
        if by_columns and keep:
            texts = texts.join(docs.select(F.col(id_col).alias("doc_id"), *keep), "doc_id")
        return rank_in_row(texts, langs, keep, max_out)
    ranked = rank(score((terms if by_columns else arrow_scoring.terms)(docs, model, id_col, text_col)))
    ranked = ranked if max_out is None else ranked.where(F.col("rank") <= max_out)
    return ranked.join(docs.select(F.col(id_col).alias("doc_id"), *keep), "doc_id") if keep else ranked


def classify_top(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", by_columns: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    return classify(docs, model, id_col, text_col, 1, by_columns, keep).drop("rank")
