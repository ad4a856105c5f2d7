"""Folding, character classes and the tokenizer's patterns, as expressions over whole strings or single characters.

Character predicates take a one-character string column. Ranges compare the code point; properties use Java's
Unicode tables, and only characters beyond ASCII reach them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0xF900, 0xFAFF))
KANA = ((0x3040, 0x30FF),)
HANGUL = ((0xAC00, 0xD7AF), (0x1100, 0x11FF), (0x3130, 0x318F))
LATIN_EXT = ((0xC0, 0x24F), (0x1E00, 0x1EFF))
GREEK = ((0x370, 0x3FF), (0x1F00, 0x1FFF))
CYRILLIC = ((0x400, 0x52F),)

(LOWER, UPPER, DIGIT, SPACE, PUNCT, C_LATIN_EXT, C_GREEK, C_CYRILLIC, C_CJK, C_KANA, C_HANGUL, OTHER) = range(12)

SYLLABIC = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CJK + KANA + HANGUL)
ALNUM = r"\p{IsAlphabetic}\p{N}"
SENTENCE_END = "[.!?…。！？\n]"
#: A run of letters and numbers that aren't syllabic, or a syllabic character by itself. What is most frequent is asked first.
TOKEN = f"[a-z0-9\\x{{df}}-\\x{{f6}}\\x{{f8}}-\\x{{ff}}[{ALNUM}&&[^{SYLLABIC}]]]+|[{SYLLABIC}]"


def code_point(c: Column) -> Column:
    return F.ascii(c)


def in_ranges(cp: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    return reduce(lambda a, b: a | b, [cp.between(lo, hi) for lo, hi in ranges])


def is_cjk(c: Column) -> Column:
    return in_ranges(code_point(c), CJK)


def is_kana(c: Column) -> Column:
    return in_ranges(code_point(c), KANA)


def is_hangul(c: Column) -> Column:
    return in_ranges(code_point(c), HANGUL)


def is_syllabic(c: Column) -> Column:
    return in_ranges(code_point(c), CJK + KANA + HANGUL)


def is_latin_ext(c: Column) -> Column:
    return in_ranges(code_point(c), LATIN_EXT)


def is_greek(c: Column) -> Column:
    return in_ranges(code_point(c), GREEK)


def is_cyrillic(c: Column) -> Column:
    return in_ranges(code_point(c), CYRILLIC)


def is_sentence_end(c: Column) -> Column:
    return c.rlike(f"^{SENTENCE_END}$") & (F.length(c) == 1)


def is_folded_alnum(c: Column) -> Column:
    """Of a folded character: a-z, 0-9, or beyond ASCII alphabetic or a number."""
    cp = code_point(c)
    return F.when(cp < 128, cp.between(97, 122) | cp.between(48, 57)).otherwise(c.rlike(f"^[{ALNUM}]"))


def class_of(c: Column) -> Column:
    """0 to 11; the first rule that holds decides."""
    cp = code_point(c)
    ascii_class = (
        F.when(cp.between(97, 122), LOWER).when(cp.between(65, 90), UPPER).when(cp.between(48, 57), DIGIT).when((cp == 32) | cp.between(9, 13), SPACE).otherwise(PUNCT)
    )
    lower = (
        F.when(in_ranges(cp, LATIN_EXT), C_LATIN_EXT).when(in_ranges(cp, GREEK), C_GREEK).when(in_ranges(cp, CYRILLIC), C_CYRILLIC)
        .when(in_ranges(cp, KANA), C_KANA).when(in_ranges(cp, HANGUL), C_HANGUL).when(in_ranges(cp, CJK), C_CJK).otherwise(OTHER)
    )
    beyond = (
        F.when(c.rlike(r"^\p{IsWhite_Space}"), SPACE)
        .when(c.rlike(r"^[\p{IsAlphabetic}&&[\p{IsLowercase}]]"), lower)
        .when(c.rlike(r"^[\p{IsAlphabetic}&&[\p{IsUppercase}]]"), UPPER)
        .when(c.rlike(r"^\p{N}"), DIGIT)
        .when(in_ranges(cp, GREEK), C_GREEK)
        .when(in_ranges(cp, CYRILLIC), C_CYRILLIC)
        .when(in_ranges(cp, KANA), C_KANA)
        .when(in_ranges(cp, HANGUL), C_HANGUL)
        .when(in_ranges(cp, CJK), C_CJK)
        .when(c.rlike(r"^\p{IsAlphabetic}"), OTHER)
        .otherwise(PUNCT)
    )
    return F.when(cp < 128, ascii_class).otherwise(beyond)


def fold(text: Column) -> Column:
    """Lower case character by character: a final sigma stays a plain one.

    Word by word, since Spark is quick with ASCII alone and slow with any string that has more.
    """
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.lower(F.replace(w, F.lit("Σ"), F.lit("σ")))), " ")


def folded(text: Column, limit: int) -> Column:
    """The first ``limit`` characters after folding."""
    return F.substring(fold(text), 1, limit)


def consumed(text: Column, limit: int) -> Column:
    """The original characters that the first ``limit`` folded ones come from: only İ folds to two."""
    pad = "﷑"
    long = F.replace(F.substring(F.replace(text, F.lit("İ"), F.lit("İ" + pad)), 1, limit), F.lit(pad), F.lit(""))
    return F.when(F.contains(text, F.lit("İ")), long).otherwise(F.substring(text, 1, limit))


def characters(text: Column) -> Column:
    """One-character strings; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def length_bin(n: Column, bins: int) -> Column:
    return F.least(n, F.lit(bins - 1))
