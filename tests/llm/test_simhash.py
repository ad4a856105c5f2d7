import re

import numpy as np
import xxhash

from langloom.llm import simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_print(text, k=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints, ids, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [brute_print(r.text) for r in docs]
    want = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(docs, prints, brute_components(prints, [r.doc_id for r in docs]), strict=True)}
    got = [tuple(r) for r in simhash.op8(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()]
    assert len(got) == len(docs) and set(got) == want
    assert any(c != d for d, _, c in got)


def test_odd_rows(spark, odd, odd_rows, empty):
    prints, ids = [brute_print(r[1]) for r in odd_rows], [r[0] for r in odd_rows]
    want = sorted(zip(map(str, ids), prints, brute_components(prints, ids), strict=True))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.deduplicate(odd)
    assert left.columns == odd.columns
    assert left.where("doc_id between 60 and 71").count() == 0 and left.where("doc_id = 4").count() == 1


def test_every_link_within_the_radius_and_rounds(spark, monkeypatch):
    """Chains of flips up to the radius, over several rounds and buckets, against all pairs."""
    monkeypatch.setattr(simhash, "ROUND_BYTES", 1 << 20)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 20_000)
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    for flips in (1, 2, 3, 4, 5, 4, 4, 3):
        for p in prints[:20]:
            for b in rng.choice(64, flips, replace=False).tolist():
                p ^= 1 << b
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    work = simhash.Workspace(spark, "test")
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(work, fps)
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert all(((a ^ b) % 2**64).bit_count() <= 4 for a, b in pairs)
    got = {r.node: r.component for r in simhash.connected_components(work, edges).collect()}
    want = brute_components(prints, signed)
    assert len(set(want)) < len(want)
    groups = lambda names: {frozenset(p for p, n in zip(signed, names, strict=True) if n == m) for m in names}
    assert groups([got.get(p, p) for p in signed]) == groups(want)


def brute_kept(rows, similarity=0.8):
    """doc_ids that stay of (doc_id, text): components of all pairs within 4 bits or of the similarity in five-word shingles."""
    ids, prints = [i for i, _ in rows], [brute_print(t, 5) for _, t in rows]
    words = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, t in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    low = list(ids)
    while True:
        before = list(low)
        for i in range(len(rows)):
            for j in range(i):
                shared = len(sets[i] & sets[j])
                if (prints[i] ^ prints[j]).bit_count() <= 4 or (shared and shared >= similarity * (len(sets[i]) + len(sets[j]) - shared)):
                    low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return {i for i, c in zip(ids, low, strict=True) if i == c}


def test_copies_with_edits_are_removed(spark, monkeypatch):
    """Edited copies on both sides of Jaccard 0.8, chains of them, and a set with more pairs than one copy takes."""
    monkeypatch.setattr(simhash, "PAIRS_A_COPY", 3)
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows = [(1, ""), (2, " "), (3, "one two"), (4, "One two"), (5, "one two three")]
    for base in range(12):
        text = word(int(rng.integers(40, 300)))
        rows.append((len(rows) + 1, " ".join(text)))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            edited = list(text)
            for at in rng.choice(len(text), max(1, int(share * len(text))), replace=False):
                edited[at] = word(1)[0]
            rows.append((len(rows) + 1, " ".join(edited)))
            if base % 2:
                text = edited
    want = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == want
    assert 20 < len(want) < len(rows) - 20


def test_different_texts_of_one_doc_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (8, b), (9, c), (9, a), (None, c), (None, "no id")]
    left = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text) for r in left.collect())) == sorted([(7, a), (7, b), (9, c), (0, "no id")])
