"""The hand-derived trace, hash vectors and classes."""

import contextlib
import io
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from langloom import constants as K
from langloom.functions import batches, chars, hashing, quantize
from langloom.functions.text import is_json_array, short_name, snippet
from langloom.operators import arrow_counts, arrow_scoring
from langloom.operators import features as X
from langloom.operators.counts import Counts, counts_by_columns, train_counts
from langloom.operators.model import build_model, token_idf
from langloom.operators.scoring import by_text, classify, rank, terms


def fnv(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def points(text: str) -> int:
    return fnv(b"".join(ord(c).to_bytes(4, "little") for c in text))


def mix(a: int, b: int) -> int:
    m = 0xFFFFFFFF
    h = (a * 0x01000193 & m) ^ 0x9E3779B9
    h = (h * 0x01000193 & m) ^ b
    h ^= h >> 15
    h = h * 0x85EBCA6B & m
    return h ^ (h >> 13)


def test_hashes(spark):
    words = ["", "a", "foobar", "ab", "cde", "naïve", "ÄÖ", "中文字", "😀x", "x" * 19, "y" * 20, "z" * 21, "w" * 60]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", hashing.fnv1a32(F.col("w")).alias("f"), F.when(F.col("w") != "", hashing.hash_token(F.col("w"))).alias("t"), hashing.crc32(F.col("w").cast("binary")).alias("c")).collect()
    for r in rows:
        assert r.f == fnv(r.w.encode()) and (not r.w or r.t == points(r.w))
    assert {r.w: r.f for r in rows}["foobar"] == 0xBF9CF968 and points("ab") == 571803110
    pairs = [(1, 2), (2, 1), (0, 0), (0xFFFFFFFF, 0xFFFFFFFF), (0x80000000, 12345), (571803110, 1957551703)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", hashing.mix(F.col("a"), F.col("b")).alias("m")).collect()
    assert all(r.m == mix(r.a, r.b) for r in got)
    three = spark.createDataFrame([("a", "é", "中")], "a string, b string, c string")
    assert three.select(hashing.hash_code_points(*[F.ascii(c) for c in "abc"]).alias("h")).first().h == points("aé中")
    assert spark.createDataFrame([(bytearray(b"123456789"),)], "b binary").select(hashing.crc32(F.col("b")).alias("c")).first().c == 0xCBF43926


CLASSES = {
    "a": 0, "Z": 1, "7": 2, " ": 3, "\n": 3, "\x0b": 3, "-": 4, "\x01": 4, "\xa0": 3, "é": 5, "ß": 5, "ω": 6, "Ω": 1, "ж": 7, "Ж": 1, "中": 8, "か": 9, "カ": 9, "한": 10, "ا": 11, "ª": 11, "½": 2,
    "٣": 2, "…": 4, "😀": 4, "ṡ": 5, "ͅ": 11, "々": 11, "Ⓐ": 1, "\U00020001": 8,
}


def test_classes_and_folding(spark):
    df = spark.createDataFrame([(c,) for c in CLASSES], "c string")
    assert {c: batches.char_class(c) for c in CLASSES} == CLASSES
    assert {r.c: r.k for r in df.select("c", chars.class_of(F.col("c")).alias("k")).collect()} == CLASSES
    texts = spark.createDataFrame([("ΟΔΟΣ",), ("İx",), ("ABCé",), ("ΣΑΣ",)], "t string")
    assert [r[0] for r in texts.select(chars.fold(F.col("t"))).collect()] == ["οδοσ", "i̇x", "abcé", "σασ"]
    pred = df.select("c", *[getattr(chars, n)(F.col("c")).alias(n) for n in ("is_cjk", "is_kana", "is_hangul", "is_syllabic", "is_latin_ext", "is_greek", "is_cyrillic", "is_folded_alnum", "is_sentence_end")])
    rows = {r.c: r for r in pred.collect()}
    assert rows["中"].is_cjk and rows["か"].is_kana and rows["한"].is_hangul and rows["한"].is_syllabic and not rows["a"].is_syllabic
    assert rows["é"].is_latin_ext and rows["ω"].is_greek and rows["ж"].is_cyrillic and rows["…"].is_sentence_end and rows["\n"].is_sentence_end
    assert rows["7"].is_folded_alnum and rows["½"].is_folded_alnum and not rows["Z"].is_folded_alnum and not rows["-"].is_folded_alnum


def test_consumed_original_characters(spark):
    cases = [("abcd", 3, "abc"), ("aİbc", 3, "aİ"), ("İİİ", 3, "İİ"), ("İİİ", 4, "İİ"), ("abİ", 2, "ab"), ("aİbc", 4, "aİb")]
    for text, limit, want in cases:
        assert spark.range(1).select(chars.consumed(F.lit(text), limit)).first()[0] == want


def test_quantisation(spark):
    row = spark.range(1).select(
        quantize.logprob(F.lit(1e-9)).alias("floor"), quantize.logprob(F.lit(0.25)).alias("q"), quantize.idf(F.lit(4.5)).alias("i"), quantize.idf(F.lit(99.0)).alias("top"),
        quantize.probability(F.lit(2.0)).alias("p"), quantize.from_idf(quantize.idf(F.lit(4.5))).alias("back"), quantize.from_logprob(quantize.logprob(F.lit(0.25))).alias("ln"), quantize.mean(F.lit(5), F.lit(0)).alias("none"),
    ).first()
    assert (row.floor, row.i, row.top, row.p, row.back, row.none) == (-32768, 4608, 64512, 65535, 4.5, 0.0) and abs(row.ln + 1.3862944) < 1e-3


def test_trace(spark):
    made = train_counts(spark.createDataFrame([(1, "xx", "Ab cde. F"), (2, "xx", ""), (3, "xx", None), (4, None, "text")], "doc_id long, lang string, text string"))
    assert tuple(made.stats.first()) == ("xx", 1, 9, 3)
    got = {(r.section, r.key, r["sub"]): r.cnt for r in made.counts.collect()}
    folded = "ab cde. f"
    want = {(0, ord(c), 0): folded.count(c) for c in folded}
    want |= {(1, points(folded[i : i + 2]), 0): 1 for i in range(8)} | {(2, points(folded[i : i + 3]), 0): 1 for i in range(7)}
    want |= {(3, points(t), 0): 1 for t in ("ab", "cde", "f")} | {(4, mix(points("ab"), points("cde")), 0): 1}
    want |= {(5, 1, 0): 1, (5, 2, 0): 1, (5, 3, 0): 1, (6, 1, 0): 1, (6, 2, 0): 1}
    want |= {(s, points(t), 0): 1 for s in (7, 8) for t in ("ab", "cde")}
    want |= {(9, ord("a"), 0): 1, (9, ord("b"), 2): 1, (9, ord("c"), 0): 1, (9, ord("d"), 1): 1, (9, ord("e"), 2): 1}
    want |= {(10, 1, 0): 1, (10, 0, 3): 1, (10, 3, 0): 1, (10, 0, 0): 2, (10, 0, 4): 1, (10, 4, 3): 1, (10, 3, 1): 1}
    assert got == want
    model = build_model(made)
    assert model.header.first().oov_logprob_q == -11092 and model.header.first().avg_doc_len == 3.0 and model.header.first().flags == 1
    q = {(r.section, r.key): r.q for r in model.ngrams.collect()}
    assert q[0, 32] == -5468 and q[0, 97] == -7561 and q[1, points("ab")] == -7105 and q[2, points("ab ")] == -6592
    assert q[3, points("ab")] == -3471 and q[4, mix(points("ab"), points("cde"))] == 0 and q[7, points("cde")] == -2092
    pos = {(r.cp, r.slot): r.q for r in model.charpos.collect()}
    assert pos[97, 0] == -2092 and pos[97, 1] == -6592 and pos[32, 2] == -7970
    cls = {(r.a, r.b): r.q for r in model.classes.collect()}
    assert len(cls) == 144 and cls[0, 0] == 36408 and cls[0, 1] == 7282 and cls[2, 5] == 21845
    hist = {(r.section, r.bin): r.q for r in model.hists.collect()}
    assert len(hist) == 96 and hist[5, 1] == hist[5, 3] == 21845 and hist[6, 1] == hist[6, 2] == 32768
    from langloom.sources.modelfile import encode

    assert len(encode(model).first().blob) == 1036


def test_idf(spark):
    keys = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "lang string, key long")
    got = {r.key: r.q for r in token_idf(keys).withColumn("q", quantize.idf(F.col("idf"))).collect()}
    assert got == {1: 187, 2: 710}


def tokens(spark, text):
    return [r.tokens for r in X.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], None).collect()]


def test_tokens(spark):
    assert tokens(spark, "ab中cd") == [["ab", "中", "cd"]]
    assert tokens(spark, "İx") == [["i", "x"]]
    assert tokens(spark, "a\nb") == [["a"], ["b"]]
    assert tokens(spark, "--") == [] and tokens(spark, "Déf中国x9") == [["déf", "中", "国", "x9"]]
    row = spark.createDataFrame([("abcdefghijkl",), ("ab",)], "t string").select(X.prefix(F.col("t")), X.suffix(F.col("t")), X.last_char(F.col("t"))).collect()
    assert tuple(row[0]) == ("abcd", "efgh", "h") and tuple(row[1]) == ("ab", "ab", "b")


def test_train_is_the_same_under_any_partitioning_and_merges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = train_counts(docs.repartition(5))
    halves = train_counts(docs.where("doc_id % 2 = 0")).merge(train_counts(docs.where("doc_id % 2 = 1")))
    for a, b in ((whole.counts, halves.counts), (whole.stats, halves.stats)):
        assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_scores_against_plain_loops(spark):
    from brute import train_plain

    rows = [
        (1, "en", "The quick brown fox, it's 12 o'clock! Naïve café."), (2, "en", "Another day. Another fox? The end"), (3, "el", "ΟΔΟΣ και Ωμέγα. Καλημέρα κόσμε!"), (4, "ja", "今日はカタカナ。한국어 text 中文字"),
        (5, "xx", "".join(chr(0x100 + i) + " " for i in range(300)) + "İx ab\nab İİ"), (6, "xx", "aa bb aa bb " * 30),
    ]
    made = train_counts(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    model = build_model(made).written()
    plain = train_plain([(r[1], r[2]) for r in rows])
    texts = [(1, "The fox. The café"), (2, "ΟΔΟΣ"), (3, ""), (4, None), (5, "--"), (6, "今日は text. ab"), (7, "x"), (8, "xy"), (9, "word " * 40), (10, rows[4][2]), (11, "The quick " * 4000), (12, "abcdefghijkl İstanbul Ⓐ ½")]
    probes = spark.createDataFrame(texts, "doc_id long, text string")
    a, b = terms(probes, model), arrow_scoring.terms(probes, model)
    assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()
    got = {(r.doc_id, r.lang): r for r in classify(probes, model).collect()}
    assert len(got) == len(texts) * 4
    for i, text in texts:
        want = plain.classify(text or "")
        for place, (lang, s, conf) in enumerate(want, 1):
            r = got[i, lang]
            assert r.rank == place and (r.score == s or abs(r.score - s) < 2e-5) and abs(r.confidence - conf) < 2e-4


def test_columns_are_compiled(spark):
    """Tokens are cut once in a plan. A generated method beyond ``tune``'s limit is never compiled: Spark then interprets its stage."""
    rows = [(i, "abcd"[i % 4], f"Text {i}, of words. Größe {i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = build_model(train_counts(docs)).written()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            made = by_text(docs, model)
            made.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert len(sizes) > 20 and max(sizes) <= 8000
    assert made._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_classes_and_tokens_of_every_code_point(spark):
    blocks = spark.range(0x110000 >> 8).where("id NOT BETWEEN 216 AND 223").select("id", F.transform(F.sequence(F.col("id") * 256, F.col("id") * 256 + 255), lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).alias("c"))
    plain = f"[{chars.SYLLABIC}]|[{chars.ALNUM}&&[^{chars.SYLLABIC}]]+"
    text = F.array_join("c", "")
    same = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (plain, chars.TOKEN)]
    assert blocks.where(same[0] != same[1]).isEmpty()
    each = blocks.select("id", F.posexplode("c").alias("i", "c")).where("id < 832 OR id >= 3584 OR i < 4")
    assert each.where(F.get(X.class_table(spark), (F.col("id") * 256 + F.col("i")).cast("int")) != chars.class_of(F.col("c"))).isEmpty()


def test_terms_of_long_texts_and_pieces(spark):
    """Texts about the bounds of pieces and of SCORE_CHARS, sentences without tokens, long tokens and characters of every size."""
    texts = [c * n for n in (1, 2, 63, 64, 65, 66, 127, 128, 129) for c in ("a", "é", "中", "\U0001d49c")]
    texts += ["ab. " * 9000, "..", " . a", "Ünïted" * 30 + "! Ab", "x" * 33000 + ". y", "ΑΣ ΑΣ. İİ İx", "a\n\nb  c ", " "]
    docs = spark.createDataFrame([(i, "pq"[i % 2], x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    model = build_model(train_counts(docs)).written()
    a, b = terms(docs, model), arrow_scoring.terms(docs, model)
    assert a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_ranks_of_ties_and_caps(spark):
    rows = [(1, 0, "a", -1.0), (1, 1, "b", -1.0), (1, 2, "c", -0.5), (2, 1, "b", float("-inf")), (2, 0, "a", float("-inf"))]
    got = {(r.doc_id, r.lang): (r["rank"], round(r.confidence, 4)) for r in rank(spark.createDataFrame(rows, "doc_id long, lang_index int, lang string, score float")).collect()}
    assert got[1, "c"][0] == 1 and got[1, "a"][0] == 2 and got[1, "b"][0] == 3 and got[2, "a"] == (1, 0.0) and got[2, "b"] == (2, 0.0)
    with pytest.raises(ValueError):
        classify(None, None, max_out=0)


def test_counts_in_batches_like_those_by_columns(spark):
    rows = [
        ("en", "Ab cde. F"), ("en", "x İx ΟΔΟΣ ab中cd twelveletters! One? two; THREE\nfour"), ("ja", "日本語のテキスト。これは Ünïted 12 ٣"), ("en", "--"), ("en", "a"), ("de", "Straße " * 12000), ("de", "İ" * 70000),
        (None, "x"), ("en", None), ("en", ""), ("ko", "한국어 ab"),
    ]
    df = spark.createDataFrame(rows, "lang string, text string")
    made = train_counts(df)
    key = lambda frame: sorted((r.lang, r.section, r.key, r.sub, r.cnt) for r in frame.collect())
    assert key(made.counts) == key(counts_by_columns(df))
    stats = {r.lang: (r.docs, r.chars_total, r.tokens_total) for r in made.stats.collect()}
    assert stats["ja"] == (1, 24, 14) and stats["ko"] == (1, 6, 4) and stats["de"][:2] == (2, 131072) and stats["en"][0] == 4


def test_batches_hand_on_full_tables(monkeypatch):
    monkeypatch.setattr(arrow_counts, "MOST_TOKENS", 12)
    counter, out = arrow_counts.Counter(), []
    texts = [f"w{i} common w{i + 1}. Ab{i}" for i in range(40)]
    for t in texts:
        counter.add("en", [t])
        if counter.full():
            out += list(counter.flush())
    out += list(counter.flush())
    whole = arrow_counts.Counter()
    whole.add("en", texts)
    total = lambda batches: sorted((k, v) for k, v in sum((Counter({(r["section"], r["key"], r["sub"]): r["cnt"]}) for b in batches for r in b.to_pylist()), Counter()).items())
    assert total(out) == total(whole.flush()) and len(out) > 24
