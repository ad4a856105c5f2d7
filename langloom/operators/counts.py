"""Training counts: ``counts(lang, section, key, sub, cnt)`` and ``stats(lang, docs, chars_total, tokens_total)``.

key is a hash, code point, bin or class; sub is the slot of a character position or the second class of a pair,
else 0. ``train_counts`` counts in Arrow batches, in one pass over the texts; the stats are sums of its sections.
``counts_by_columns`` is the same in column expressions: texts are exploded once for characters, once for tokens and
once for sentences, and equal windows and token pairs are summed on the map side before anything is hashed or shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.functions import chars, hashing
from langloom.operators import arrow_counts
from langloom.operators import features as X
from langloom.session import spread
from langloom.workspace import written


def _entry(section: int, key: Column, sub: Column | int = 0) -> Column:
    sub = sub if isinstance(sub, Column) else F.lit(sub)
    return F.struct(F.lit(section).cast("int").alias("section"), key.cast("long").alias("key"), sub.cast("int").alias("sub"))


def _sum(rows: DataFrame, entries: Column) -> DataFrame:
    """Entries (an array with nulls where a row has none) weighted by ``n``."""
    flat = rows.select("lang", "n", F.inline(F.array_compact(entries)))
    return flat.groupBy("lang", "section", "key", "sub").agg(F.sum("n").alias("cnt"))


def known_texts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: Sequence[str] = ()) -> DataFrame:
    """Rows that training sees: text and language there, text not empty."""
    return df.select(*keep, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")


def char_counts(texts: DataFrame) -> DataFrame:
    """Sections of characters, n-grams and class pairs."""
    windows = X.char_windows(texts, ["lang"], K.TRAIN_CHARS, True).groupBy("lang", "c1", "c2", "c3", "o1", "o2").agg(F.count("*").alias("n"))
    a, b, c = (F.ascii(x) for x in ("c1", "c2", "c3"))
    keyed = windows.select(  # as columns, where common parts are computed once; generators evaluate theirs one by one
        "lang",
        "n",
        a.alias("u"),
        F.when(F.col("c2").isNotNull(), hashing.hash_code_points(a, b)).alias("h2"),
        F.when(F.col("c3").isNotNull(), hashing.hash_code_points(a, b, c)).alias("h3"),
        F.when(F.col("o2").isNotNull(), chars.class_of(F.col("o1"))).alias("ka"),
        F.when(F.col("o2").isNotNull(), chars.class_of(F.col("o2"))).alias("kb"),
    )
    found = [(K.CHAR_UNIGRAM, "u", 0), (K.CHAR_BIGRAM, "h2", 0), (K.CHAR_TRIGRAM, "h3", 0), (K.CLASS_PAIR, "ka", F.col("kb"))]
    return _sum(keyed, F.array(*[F.when(F.col(k).isNotNull(), _entry(section, F.col(k), sub)) for section, k, sub in found]))


def token_counts(texts: DataFrame) -> DataFrame:
    """Sections of tokens, pairs of tokens, word lengths, affixes and character positions.

    Token pairs are summed first; what depends on one token comes from the sums by token. Both branches read one shuffle.
    """
    pairs = X.token_pairs(X.sentences(texts, ["lang"], K.TRAIN_CHARS), ["lang"]).groupBy("lang", "token", "previous").agg(F.count("*").alias("n"))
    bigram = hashing.mix(hashing.hash_token(F.col("previous")), hashing.hash_token(F.col("token"))).alias("key")
    # a condition on the previous token would move below the first sum, and the two branches would read the text apart
    bigrams = pairs.groupBy("lang", bigram).agg(F.sum(F.when(F.col("previous").isNotNull(), F.col("n"))).alias("cnt")).where("cnt IS NOT NULL")
    bigrams = bigrams.select("lang", F.lit(K.TOKEN_BIGRAM).alias("section"), "key", F.lit(0).alias("sub"), "cnt")

    tokens = pairs.groupBy("lang", "token").agg(F.sum("n").alias("n"))
    t, two = F.col("token"), X.has_affix(F.col("token"))
    tokens = tokens.select(
        "lang",
        "n",
        "token",
        hashing.hash_token(t).alias("th"),
        F.when(two, hashing.hash_token(X.prefix(t))).alias("ph"),
        F.when(two, hashing.hash_token(X.suffix(t))).alias("sh"),
    )
    inner = F.transform(F.split(F.substring(X.head(t), F.lit(2), F.length(X.head(t)) - 2), ""), lambda x: _entry(K.CHAR_POSITION, F.ascii(x), 1))
    found = F.array(
        _entry(K.TOKEN_UNIGRAM, F.col("th")),
        _entry(K.WORD_LENGTH, chars.length_bin(F.length(t), K.WORD_BINS)),
        F.when(two, _entry(K.PREFIX, F.col("ph"))),
        F.when(two, _entry(K.SUFFIX, F.col("sh"))),
        F.when(two, _entry(K.CHAR_POSITION, F.ascii(X.first_char(t)), 0)),
        F.when(two, _entry(K.CHAR_POSITION, F.ascii(X.last_char(t)), 2)),
    )
    return bigrams.unionByName(_sum(tokens, F.when(F.length(t) >= 3, F.concat(found, inner)).otherwise(found)))


def sentence_counts(texts: DataFrame) -> DataFrame:
    bins = X.sentences(texts, ["lang"], K.TRAIN_CHARS).select("lang", chars.length_bin(F.size("tokens"), K.SENTENCE_BINS).alias("b"))
    return bins.groupBy("lang", "b").agg(F.count("*").alias("cnt")).select("lang", F.lit(K.SENTENCE_LENGTH).alias("section"), F.col("b").cast("long").alias("key"), F.lit(0).alias("sub"), "cnt")


def token_document_counts(texts: DataFrame) -> DataFrame:
    """(lang, key, df): documents (rows) of each language that have the token."""
    return arrow_counts.document_frequencies(texts, K.TRAIN_CHARS)


@dataclass(frozen=True)
class Counts:
    counts: DataFrame
    stats: DataFrame

    def merge(self, other: Counts) -> Counts:
        """Of two disjoint sets of texts."""
        both = self.counts.unionByName(other.counts).groupBy("lang", "section", "key", "sub").agg(F.sum("cnt").alias("cnt"))
        stats = self.stats.unionByName(other.stats).groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("docs", "chars_total", "tokens_total")])
        return Counts(both, stats)

    def section(self, section: int) -> DataFrame:
        return self.counts.where(F.col("section") == section)

    def token_keys(self) -> DataFrame:
        """Distinct (lang, key) of tokens."""
        return self.section(K.TOKEN_UNIGRAM).select("lang", "key")


def train_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Counts:
    """Counted in one pass and written, so both tables come from what is small."""
    texts = known_texts(spread(df.select(F.col(text_col), F.col(lang_col))), text_col, lang_col)
    made = written(arrow_counts.count(texts, K.TRAIN_CHARS), "counts")
    total = lambda section: F.coalesce(F.sum(F.when(F.col("section") == section, F.col("cnt"))), F.lit(0)).cast("long")
    stats = made.groupBy("lang").agg(total(arrow_counts.DOCUMENTS).alias("docs"), total(K.CHAR_UNIGRAM).alias("chars_total"), total(K.TOKEN_UNIGRAM).alias("tokens_total"))
    return Counts(made.where(F.col("section") >= 0), written(stats, "stats"))


def counts_by_columns(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts in column expressions only."""
    texts = known_texts(spread(df.select(F.col(text_col), F.col(lang_col))), text_col, lang_col)
    return char_counts(texts).unionByName(token_counts(texts)).unionByName(sentence_counts(texts))
