import re
from collections import Counter

from langloom.llm import rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in many for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_counters_on_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = rules.op10(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = rules.quality_rules(odd, None).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(brute(r[1]) for r in odd_rows)
    assert all(r.kept is not r.base_failed for r in got)
    assert rules.quality_rules(empty, None).count() == 0
    assert rules.train(odd, spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")) is None


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = rules.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = rules.quality_rules(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.93
