import base64
import hashlib

import public_tokenizers as P
import tiktoken

from langloom.llm import bpe


def reference():
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library_on_whole_tables(spark, sf_dir):
    lib = reference()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op1(spark, sf_dir).collect():
        ids = lib.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows_and_round_trip(spark, odd, empty):
    lib = reference()
    got = bpe.decode(bpe.encode(odd)).join(odd.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == odd.where("doc_id is not null").count()
    for r in got:
        assert r.ids == lib.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty).collect() == []


def test_long_rows_and_bounded_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    monkeypatch.setattr(bpe, "WALK_CHARS", 500)
    with open(P.path(bpe.VOCABULARY), "rb") as f:
        mine = bpe.Encoder(f.read(), P.PATTERN)
    lib = reference()
    texts = ["a" * 300, "ab" * 700 + "é" * 200, "the quick brown fox " * 40, " " * 900, "x", "", "\U0001f600" * 90, "'s I'LL we're"]
    assert mine.encode_batch(texts) == [lib.encode_ordinary(t) for t in texts]
