import random

import corpus_pipeline
import pytest
from test_bpe import reference
from test_decontam import brute as leaks
from test_secrets import BASE, EXTRA
from test_simhash import brute_kept

from langloom.llm import bpe, decontam, hilbert, langid, licenses, quality_net, rules, secrets, simhash, stages
from langloom.llm.common import beside, scratch, Workspace
from langloom.workspace import shared_dir


def test_run_against_a_plain_version(spark, sf_dir):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = rules.quality_rules(docs, rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = [r for r in judged.collect() if r.kept]
    stay = brute_kept([(r.doc_id, r.text) for r in kept])
    left = [r for r in kept if r.doc_id in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id: r.text for r in left if not leaks(r.text, items)[1]}
    assert set(got) == set(left) and 0 < len(left) < len(kept) < docs.count()
    lib = reference()
    for doc_id, text in left.items():
        spans = sorted((m.start(), m.end()) for k, p, g, n in BASE + EXTRA for m in p.finditer(text) if len(m.group(g)) >= n)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert got[doc_id].ids == lib.encode_ordinary(out + text[at:])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "byte_bpe"]


def test_near_copies_leave_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in stages.near_duplicates(spark, docs, sf_dir).collect()} == want


EXTRA_COLUMNS = ("fp", "kept", "n_hit", "ids", "a.b", "Score", "row", "c0", "__text", "n_words", "hit_items", "spans_hex", "decoded", "lang_pred", "rejected", "own_license", "license", "n_tokens", "predicted", "probability")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns that have the names of computed ones, and names that need quotes."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=80)), "en", "web", 0, *[f"{c}-{i}" for c in EXTRA_COLUMNS]) for i in range(1, 40)]
    rows += [(50, rows[7][1], *rows[7][2:5], *[f"{c}-50" for c in EXTRA_COLUMNS])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA_COLUMNS))


def test_stages_leave_columns_alone(spark, sf_dir, clashing):
    before = {r.doc_id: r for r in clashing.collect()}
    for name, stage in stages.STAGES[:-1]:
        after = stage(spark, clashing, sf_dir)
        assert after.columns == clashing.columns, name
        rows = after.collect()
        assert len(rows) > 0 or name == "quality_rules"
        for r in rows:
            assert all(r[c] == before[r.doc_id][c] for c in clashing.columns if c != "n_chars"), name
    assert 50 not in {r.doc_id for r in stages.near_duplicates(spark, clashing, sf_dir).collect()}
    last = stages.encoding(spark, clashing, sf_dir)
    assert all(r["ids_input"] == f"ids-{r.doc_id}" and r["a.b"] == f"a.b-{r.doc_id}" and r.n_tokens == len(r.ids) for r in last.collect())


def test_operators_keep_columns_of_their_own_names(spark, sf_dir, clashing):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    vectors = spark.sparkContext.broadcast(quality_net.word_vectors(clashing))
    done = {
        "bpe": bpe.encode(clashing, with_decoded=True), "decontam": decontam.find_leaks(clashing, bench), "langid": langid.identify(clashing, langid.train(clashing)), "rules": rules.quality_rules(clashing, None),
        "quality": quality_net.classify(clashing, vectors, quality_net.Constant(0.5)), "secrets": secrets.find_secrets(clashing), "simhash": simhash.fingerprints(clashing), "licenses": licenses.inherit(licenses.scan(clashing), "source"),
    }
    for name, df in done.items():
        rows = df.collect()
        assert len(rows) == 40, name
        for r in rows:
            for c in EXTRA_COLUMNS:
                assert r[f"{c}_input" if f"{c}_input" in df.columns else c] == f"{c}-{r.doc_id}", (name, c)
    hilbert.write_shards(clashing, hilbert.shard_documents(clashing, 2, carry=True), f"{shared_dir(spark)}/clash")
    assert spark.read.parquet(f"{shared_dir(spark)}/clash").where("`a.b` = concat('a.b-', doc_id)").count() == 40


def test_names_beside_computed_ones():
    assert beside(["a", "Ids", "ids_input", "b.c"], ["ids"]) == ["a", "Ids_input_input", "ids_input", "b.c"]


def test_workspaces_go(spark):
    with scratch():
        work = Workspace(spark, "test")
        work.keep(spark.range(3).toDF("x"), "one")
        path = spark._jvm.org.apache.hadoop.fs.Path(work.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert system.exists(path)
    assert not system.exists(path)


def test_repeated_ids_in_the_pipeline_stage(spark, sf_dir):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(5, a, "p"), (5, b, "q"), (6, b + " z", "r")], "doc_id long, text string, kept string")
    assert sorted(map(tuple, stages.near_duplicates(spark, docs, sf_dir).collect())) == [(5, a, "p"), (5, b, "q")]
