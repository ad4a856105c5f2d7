import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from langloom.llm import hilbert, langid, quality_net

PART = re.compile(r"(?:[^\W_]|[^\x00-\x7f])+|[^\w\s]+|_")


def test_hilbert_curve_is_a_path_through_all_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        at = hilbert.curve_index([grid[:, i] for i in range(dims)], bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, odd, odd_rows, empty, tmp_path):
    rows = hilbert.shard_documents(odd).collect()
    assert len(rows) == len(odd_rows)
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == want
    assert hilbert.shard_documents(empty).count() == 0
    few = odd.where("doc_id = 10")
    assert [(r.shard, r.slot) for r in hilbert.shard_documents(few).collect()] == [(0, 0)]


def test_written_shards_have_every_row_once(spark, odd, odd_rows, tmp_path):
    docs = odd.drop("note")
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    for carry in (True, False):
        hilbert.write_shards(docs, hilbert.shard_documents(docs, 3, carry=carry), f"{tmp_path}/all")
        back = spark.read.parquet(f"{tmp_path}/all").select("doc_id", "text", "lang", "shard", "slot").collect()
        assert sorted(map(key, back)) == sorted(map(key, odd_rows))
        counts = [sum(r.shard == s for r in back) for s in range(3)]
        assert sorted((r.shard, r.slot) for r in back) == [(s, k) for s in range(3) for k in range(counts[s])]


def test_shards_of_a_table(spark):
    """Every row's place, recomputed in plain Python; equal texts are apart only where a cut falls between them."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows = {r.doc_id: r for r in hilbert.op5(spark, d).collect()}
    cell = lambda v: 0 if v is None else int(hashlib.md5(v.encode()).hexdigest()[:4], 16) % 32
    axes = [[cell(r.lang) for r in docs], [cell(r.source) for r in docs], [min(31, (len(r.text.encode()) + 1).bit_length()) for r in docs]]
    curve = hilbert.curve_index([np.array(a) for a in axes]).tolist()
    groups = {}
    for r, c in zip(docs, curve, strict=True):
        groups.setdefault(r.text, []).append(c)
    raw = lambda r: r.text.encode()
    order = sorted(docs, key=lambda r: (min(groups[r.text]), -len(groups[r.text]), zlib.crc32(raw(r)), len(raw(r)) + 1, hashlib.sha256(raw(r)).hexdigest(), r.doc_id))
    small, more = divmod(len(docs), 8)
    want = [(s, k) for s in range(8) for k in range(small + (s < more))]
    for r, (shard, slot) in zip(order, want, strict=True):
        got = rows[r.doc_id]
        assert (got.shard, got.slot, got["size"], got.text_crc32, got.law, got.grown_shard) == (shard, slot, len(raw(r)) + 1, zlib.crc32(raw(r)), "rows", None)
    apart = [t for t, c in groups.items() if len(c) > 1 and len({rows[r.doc_id].shard for r in docs if r.text == t}) > 1]
    assert len([c for c in groups.values() if len(c) > 1]) > 50 and len(apart) <= 7


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = langid.op6(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, empty):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        has = bool(langid.LETTER.search(r.text or ""))
        assert (r.lang_pred == "und") == (not has)
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_quality_network_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_net.op4(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_network_odd_rows(spark, odd, empty):
    vectors = spark.sparkContext.broadcast(quality_net.word_vectors(odd))
    assert quality_net.word_vectors(empty).shape == (quality_net.WORDS, quality_net.DIM)
    nothing = quality_net.train(odd, spark.createDataFrame([], "doc_id long, quality int"), vectors)
    assert {r.score for r in quality_net.classify(odd, vectors, nothing).collect()} == {0.5}
    net = quality_net.train(odd, spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(None, 1), (11, None)], "doc_id long, quality int"), vectors)
    rows = quality_net.classify(odd, vectors, net).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_net.classify(empty, vectors, net).count() == 0


def test_word_vectors_like_a_plain_count(spark):
    texts = ["a b c a", "b !! b", "", "c"]
    got = quality_net.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    place, sign = quality_net.index_vectors()
    want = np.zeros((quality_net.WORDS, quality_net.DIM))
    for t in texts:
        w, _ = quality_net.buckets([t.encode()])
        for i, a in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if j != i:
                    np.add.at(want[a], place[w[j]], sign[w[j]])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.maximum(1e-9, norm), atol=1e-5)


def test_pooled_features_and_scores_in_plain_python():
    """Features, network and temperature, token by token."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality_net.WORDS, quality_net.DIM)).astype(np.float32)
    texts = ["a b, c", "", "one one one two !! ??", "x" * 9, "été 12 34"] + [" ".join(f"w{k % 7 * i}" for k in range(50)) for i in range(20)]
    want = []
    for t in texts:
        tokens = [int(b) for x in PART.findall(t) for b in quality_net.buckets([x.encode()])[0]]
        n = len(tokens)
        if not n:
            want.append([0.0] * quality_net.FEATURES)
            continue
        mean = [sum(float(vectors[k][d]) for k in tokens) / n for d in range(quality_net.DIM)]
        spread = [math.sqrt(max(0, sum(float(vectors[k][d]) ** 2 for k in tokens) / n - mean[d] ** 2)) for d in range(quality_net.DIM)]
        again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        want.append([*mean, *spread, again / n, len(set(tokens)) / math.sqrt(n), math.log1p(n)])
    got = quality_net.pool([t.encode() for t in texts], vectors)
    assert np.allclose(got, want, atol=1e-3)
    long = quality_net.buckets([texts[2].encode()])[0]
    assert np.allclose(quality_net.pool_long(long, vectors), want[2], atol=1e-3)
    net = quality_net.Network(np.array(want), np.arange(len(texts)) % 2, epochs=3)
    w1, b1, w2, b2 = net.weights
    for x, p in zip(want, net.score(np.array(want)), strict=True):
        h = [math.tanh(sum((x[i] - net.mean[i]) / net.scale[i] * w1[i][k] for i in range(len(x))) + b1[k]) for k in range(len(b1))]
        assert math.isclose(p, 1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, w2, strict=True)) + b2[0]) / net.temperature)), abs_tol=1e-9)


def test_language_scores_in_plain_python(spark):
    """Document frequencies, weights and cosines of whole texts, n-gram by n-gram."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.train(docs)
    rows = docs.collect()

    def grams(text):
        line = b" " + b" ".join(re.findall(rb"[^ ]+", text.encode().translate(langid.FOLD))) + b" "
        keys = [int.from_bytes(line[i : i + 2], "little") for i in range(len(line) - 1)] + [int.from_bytes(line[i : i + 3], "little") | 1 << 24 for i in range(len(line) - 2)]
        return Counter((k * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BITS) for k in keys)

    counts = [grams(r.text) for r in rows]
    df = Counter(k for c, r in zip(counts, rows, strict=True) if r.lang is not None for k in c)
    n = sum(r.lang is not None for r in rows)
    assert np.allclose(model.idf, [math.log((n + 1) / (df[k] + 1)) + 1 for k in range(1 << langid.BITS)])
    for c, r in list(zip(counts, rows, strict=True))[:60]:
        w = {k: (1 + math.log(m)) * model.idf[k] for k, m in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        cos = [sum(x / norm * float(model.centroids[k, j]) for k, x in w.items()) for j in range(len(model.owner))]
        name, score, _ = model.predict(r.text.encode())
        assert math.isclose(score, max(cos), abs_tol=1e-4) and max(cos) - max(x for x, o in zip(cos, model.owner, strict=True) if model.langs[o] == name) < 1e-4
    monkey = "word " * 1000
    whole = langid.vector(monkey.encode())
    before, langid.PIECE = langid.PIECE, 64
    assert all((a == b).all() for a, b in zip(whole, langid.vector(monkey.encode()), strict=True))
    langid.PIECE = before
