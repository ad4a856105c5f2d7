"""Features of texts as rows.

Every function is a projection and one generator over the text: no shuffle, no window. Neighbouring characters come
from zipped slices of one array, so a text costs time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from langloom.functions import chars, hashing

#: Characters of a text that are dealt out together.
PIECE = 64


def char_windows(df: DataFrame, keep: Sequence[str], limit: int, original: bool) -> DataFrame:
    """``keep``, c1, c2, c3: each folded character with the two after it (null past the end), of column ``text``.

    With ``original``, o1 and o2 also: each original character and the next.
    """
    rows = df.select(*keep, chars.characters(chars.folded(F.col("text"), limit)).alias("__c"), *([chars.characters(chars.consumed(F.col("text"), limit)).alias("__o")] if original else []))
    c = F.col("__c")
    parts = [c.alias("c1"), F.slice(c, 2, limit).alias("c2"), F.slice(c, 3, limit).alias("c3")]
    if original:
        o = F.col("__o")
        parts += [o.alias("o1"), F.slice(o, 2, limit).alias("o2")]
    return rows.select(*keep, F.inline(F.arrays_zip(*parts)))


def code_points(text: Column) -> Column:
    """Of a text that isn't empty, as an array."""
    return F.transform(F.split(text, ""), lambda c: chars.code_point(c).cast("long"))


def code_windows(df: DataFrame, keep: Sequence[str], limit: int) -> DataFrame:
    """``keep``, u, h2, h3, k1, k2: of each folded character the code point, the hashes of it with the next one and the next two, and
    the classes of it and the next (null past the end), of column ``text``, which isn't empty.

    Texts are dealt out in pieces that end with the two characters after them, so a row that Spark copies is short however long the
    text is; strings end with the text, and all that is done for a character is compiled.
    """
    rows = df.select(*keep, code_points(chars.folded(F.col("text"), limit)).alias("__p"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("__p"), F.lit(PIECE)), lambda i: F.slice("__p", i, F.lit(PIECE + 2)))
    rows = rows.select(*keep, F.explode(pieces).alias("__p"))
    rows = rows.select(*keep, "__p", F.posexplode(F.slice("__p", 1, PIECE)).alias("__i", "u"))
    after = lambda k: F.get(F.col("__p"), F.col("__i") + k)
    rows = rows.select(*keep, "u", after(1).alias("__b"), after(2).alias("__c"))
    kinds = class_table(df.sparkSession)
    kind = lambda c: F.get(kinds, F.col(c).cast("int")).cast("int")
    rows = rows.select(*keep, "u", "__c", hashing.hash_code_points(F.col("u"), F.col("__b")).alias("h2"), kind("u").alias("k1"), kind("__b").alias("k2"))
    return rows.select(*keep, "u", "h2", hashing.hash_code_points(F.col("__c"), after=F.col("h2")).alias("h3"), "k1", "k2")


def class_table(spark: SparkSession) -> Column:
    """The class of every code point, an array that a scalar subquery makes once a query.

    Characters are looked at only in blocks that have one which isn't PUNCT; every range of a script has letters in each of its blocks.
    """
    text = lambda cp: F.when(cp.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
    blocks = spark.range(0x110000 >> 8).select("id", F.transform(F.sequence(F.col("id") * 256, F.col("id") * 256 + 255), text).alias("c"))
    some = (F.col("id") == 0) | F.array_join("c", "").rlike(rf"[\p{{IsWhite_Space}}{chars.ALNUM}]")
    each = F.transform("c", lambda c: chars.class_of(c).cast("tinyint"))
    blocks = blocks.select("id", F.when(some, each).otherwise(F.array_repeat(F.lit(chars.PUNCT).cast("tinyint"), 256)).alias("k"))
    return blocks.select(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "k"))), lambda b: b["k"])).alias("k")).scalar()


def cut_sentences(df: DataFrame, keep: Sequence[str], limit: int | None) -> DataFrame:
    """``keep``, tokens: the tokens of each sentence; sentences without any may be among them."""
    text = chars.fold(F.col("text")) if limit is None else chars.folded(F.col("text"), limit)
    cut = df.select(*keep, F.explode(F.split(text, chars.SENTENCE_END)).alias("__s"))
    return cut.select(*keep, F.regexp_extract_all("__s", F.lit(chars.TOKEN), F.lit(0)).alias("tokens"))


def sentences(df: DataFrame, keep: Sequence[str], limit: int | None) -> DataFrame:
    """``keep``, tokens: the tokens of each sentence that has any."""
    return cut_sentences(df, keep, limit).where(F.size("tokens") > 0)


def token_pairs(sents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, token, previous: previous is null for the first of a sentence."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("tokens", 1, F.size("tokens") - 1))
    return sents.select(*keep, F.inline(F.arrays_zip(F.col("tokens").alias("token"), before.alias("previous"))))


def hashed_pairs(sents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, p, th, ph, run: a token's code points, its hash, the hash of the one before it (null for the first of a sentence),
    and, for the first alone, the number of tokens of its sentence. Each hash is computed once.
    """
    rows = sents.select(*keep, F.transform("tokens", code_points).alias("__p"))
    rows = rows.select(*keep, "__p", F.transform("__p", hashing.hash_array).alias("__h"))
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice("__h", 1, F.greatest(F.size("__h") - 1, F.lit(0))))
    before = F.slice(before, 1, F.size("__h"))
    rows = rows.select(*keep, F.size("__p").alias("__n"), F.inline(F.arrays_zip(F.col("__p").alias("p"), F.col("__h").alias("th"), before.alias("ph"))))
    return rows.select(*keep, "p", "th", "ph", F.when(F.col("ph").isNull(), F.col("__n")).alias("run"))


def hashed_affixes(p: Column, th: Column) -> tuple[Column, Column]:
    """Hashes of the prefix and the suffix of a token, by its code points and its hash."""
    short, end = F.size(p) <= 4, F.least(F.size(p), F.lit(8)) - 3
    return F.when(short, th).otherwise(hashing.hash_array(F.slice(p, 1, 4))), F.when(short, th).otherwise(hashing.hash_array(F.slice(p, F.greatest(end, F.lit(1)), F.lit(4))))


def head(token: Column) -> Column:
    """The characters that affixes are taken from."""
    return F.substring(token, 1, 8)


def has_affix(token: Column) -> Column:
    return F.length(token) >= 2


def prefix(token: Column) -> Column:
    return F.substring(token, 1, 4)


def suffix(token: Column) -> Column:
    return F.right(head(token), F.lit(4))


def first_char(token: Column) -> Column:
    return F.substring(token, 1, 1)


def last_char(token: Column) -> Column:
    return F.right(head(token), F.lit(1))
