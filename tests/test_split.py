from langloom import constants as K
from langloom.operators.split import cap, strided_split
from langloom.plans import queries


def scan(ids, max_docs, eval_docs):
    """The reference's loop over one language's documents."""
    stride, since, held, taken = max(1, max_docs // max(1, eval_docs)), 0, [], []
    for i in ids:
        if len(taken) >= max_docs:
            break
        since += 1
        if len(held) < eval_docs and since >= stride:
            since = 0
            held.append(i)
        else:
            taken.append(i)
    return {(i, "eval") for i in held} | {(i, "train") for i in taken}


def test_small_caps_against_the_plain_scan(spark):
    rows = [(i, lang, "t") for lang, n in (("a", 90), ("b", 33), ("c", 2)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    for max_docs, eval_docs in ((20, 4), (7, 3), (50, 50), (1000, 10)):
        got = {(r.lang, r.doc_id, r.split) for r in strided_split(docs, ["doc_id"], max_docs, eval_docs).collect()}
        assert got == {(lang, i, s) for lang, n in (("a", 90), ("b", 33), ("c", 2)) for i, s in scan(range(n), max_docs, eval_docs)}
        capped = {(r.lang, r.doc_id) for r in cap(docs, ["doc_id"], max_docs).collect()}
        assert capped == {(lang, i) for i, lang, _ in rows if i < max_docs}


def test_queries_have_the_reference_defaults_and_drop_no_rows(spark):
    d = "/root/testdata/sf0.01"
    assert (queries.SPLIT_DOCS, queries.SPLIT_EVAL) == (K.MAX_DOCS, K.EVAL_DOCS) == (512_000, 300)
    known = {r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").where("lang IS NOT NULL AND text <> ''").collect()}
    assert {r.doc_id for r in queries.doc_cap(spark, d).collect()} == known
    assert {r.doc_id for r in queries.train_eval_split(spark, d).collect()} == known
