import hashlib
import random
import re

from langloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    seq, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            key = w[i : i + window]
            for a in range(len(seq) - len(key) + 1):
                if seq[a : a + len(key)] == key:
                    hit |= set(range(a, a + len(key)))
                    found.add(name)
    return len(seq), len(hit), sorted(str(f) for f in found if f is not None)


def test_whole_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = decontam.op9(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_odd_rows_and_passes(spark, odd, odd_rows, empty, monkeypatch):
    items = [(1, "ONE"), (2, None), (3, ""), (4, "- -"), (5, "long, long; LONG"), (None, "été naïve"), (6, odd_rows[25][1]), (6, odd_rows[25][1]), (7, odd_rows[40][1]), (8, "long " * 11)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(r[0]), *brute(r[1], items)) for r in odd_rows if r[0] != 81)
    long = (30000, 30000, ["5", "8"])
    for passes in (64 << 20, 400):
        monkeypatch.setattr(decontam, "PASS_BYTES", passes)
        rows = decontam.find_leaks(odd, bench).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.hit_items) for r in rows if r.doc_id != 81) == want
        assert [(r.n_words, r.n_hit, r.hit_items) for r in rows if r.doc_id == 81] == [long]
        for r in rows:
            cut = [w for s in r.hit_spans for w in words(r.text[s.start : s.end])]
            assert len(cut) == r.n_hit
    assert decontam.find_leaks(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontam.find_leaks(odd, bench.limit(0)).collect())


def test_automaton_of_the_windows_at_hand(monkeypatch):
    for whole in (100, 0):
        monkeypatch.setattr(decontam, "WHOLE_WINDOWS", whole)
        windows_at_hand()


def windows_at_hand():
    items = [("a", b"one two three four"), ("b", b"two three four five"), (None, b"two"), ("a", b"one two three four"), ("c", b"")]
    small = decontam.Benchmark(items, 3)
    assert small.widths == [1, 3] and len(small.hashes) == 7
    for text in (b"zero one two three", b"two", b"three four five six", b"none"):
        ranges, found = [[]], [set()]
        decontam._scan([text], small, ranges, found)
        n, hit, names = brute(text.decode(), [(n, t.decode()) for n, t in items], 3)
        assert sum(b - a for a, b in decontam.merge(ranges[0])) == hit and sorted(x for x in found[0] if x) == names


def test_a_large_benchmark_and_a_long_text(spark, tmp_path):
    """20 MB of items, a text of 8 MB: what the driver gathers is bounded by the pass."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(50_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=400))) for i in range(6000)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=60)) + " " + " ".join(items[i * 7][1].split()[30 : 30 + i]) + " tail") for i in range(20)]
    docs.append((99, " ".join(rng.choices(vocabulary, k=1_000_000)) + " " + items[5][1]))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/b")
    bench = spark.read.parquet(f"{tmp_path}/b")
    rows = {r.doc_id: r for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench, keep=["doc_id"]).collect()}
    for i in range(20):
        assert (rows[i].n_hit, rows[i].hit_items) == ((i, [str(i * 7)]) if i >= 10 else (0, []))
    assert (rows[99].n_words, rows[99].n_hit, rows[99].hit_items) == (1_000_400, 400, ["5"])
