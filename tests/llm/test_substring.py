import hashlib
import random
import re

import numpy as np

from langloom.llm import substring
from langloom.llm.tokens import tokenize

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width=50):
    low, out = {}, []
    seqs = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in seqs:
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i : i + width])
                low[key] = min(low.get(key, d), d)
    for d, w in seqs:
        gone = {i + k for i in range(len(w) - width + 1) if d is not None and low[tuple(w[i : i + width])] < d for k in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.op7(spark, str(path)).collect())


def test_whole_tables(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        want = brute(rows)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.op7(spark, d).collect()) == want
        assert any(w[2] for w in want)


def test_planted_passages_runs_and_odd_rows(spark, odd_rows, tmp_path):
    rng = random.Random(11)
    text = lambda n, words=400: " ".join(f"w{rng.randrange(words)}" for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 60, 75, 130)] + ["a " * 70, "a b " * 60, "x y z " * 30 + "q " * 55, text(200, 2), text(120, 3)]
    rows = [(r[0], r[1]) for r in odd_rows]
    rows.append((79, "intro " + "long " * 70))
    for i in range(150):
        parts = [text(rng.randrange(0, 120)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(passages))
        parts.insert(rng.randrange(4), rng.choice(passages))
        rows.append((1000 + rng.randrange(130), " ".join(parts)))
    rows += [(i, rows[-1][1]) for i in range(1200, 1210)] + [(900, rows[-3][1]), (None, rows[-3][1])]
    rng.shuffle(rows)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, empty):
    assert substring.remove_repeats(empty).count() == 0


def test_symbols_inside_a_window_are_the_same_wherever_it_occurs():
    rng = random.Random(2)
    for words in (3, 30, 300):
        core = " ".join(f"w{rng.randrange(words)}" for _ in range(80))
        seen = []
        for _ in range(30):
            side = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(40))) for _ in range(2)]
            line = f"{side[0]} {core} {side[1]}".encode()
            at = len(side[0].split())
            name, start, end, low, high = substring.recompress(*tokenize([b"other text", line, b"more"]))
            at += 2
            inside = (low >= at) & (high <= at + 80)
            seen.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(name[inside], start[inside], end[inside], strict=True)})
            assert all(any(x[1] == s - at and x[2] == e - at for x in seen[-1]) for s, e in zip(start[inside], end[inside], strict=True))
        # a symbol that the words of the window fix in one place is there in every other
        fixed = set.union(*seen)
        for names in seen:
            assert fixed == names


def test_window_names():
    words = [f"w{i * i % 90}".encode() for i in range(400)]
    at = np.arange(351)
    names = [tuple(x) for x in substring.window_names(words, at).tolist()]
    keys = [tuple(words[i : i + 50]) for i in range(351)]
    assert len(set(keys)) == len(set(names)) == len(set(zip(keys, names, strict=True)))
    assert names[7:9] == [tuple(x) for x in substring.window_names(words[3:], np.array([4, 5])).tolist()]
    assert names[0] == tuple(np.frombuffer(hashlib.blake2b(b" ".join(words[:50]), digest_size=16).digest(), np.int64).tolist())


def test_words_whose_hashes_collide_are_different(spark, tmp_path):
    """Thue-Morse words: polynomial hashes modulo 2**64 agree on them, whatever the base."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    assert tokenize([a.encode()])[0] == tokenize([b.encode()])[0]
    frame = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*frame[:40], w, *frame[40:60]])) for i, w in enumerate((a, b, a))]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert [x[2] for x in brute(rows)] == [0, 0, 61]


def test_columns_of_any_name(spark, odd_rows):
    rows = [(r[0], r[1], "x", "y") for r in odd_rows]
    docs = spark.createDataFrame(rows, "`a.b` long, `kept` string, tag string, starts string")
    got = sorted((str(r["a.b"] if "a.b" in r else r.doc_id), r.n_removed) for r in substring.remove_repeats(docs, "kept", "a.b").collect())
    assert got == [(x[0], x[2]) for x in sorted(brute([r[:2] for r in rows]))]
