"""What larger tables have and the small ones don't."""

import duckdb
from oracle import plain

from langloom.plans import queries
from langloom.plans.oracle import ORACLE_SQL


def differs(spark, tmp_path, name, **tables):
    """The rows that only one of query and SQL has, over tables given as (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in con.sql(ORACLE_SQL[name]).select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()), key=repr)
    return set(mine) ^ set(theirs) or len(mine) - len(theirs)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_classes_of_empty_texts(spark, tmp_path):
    rows = [(1, "", "en", "a"), (2, "Ab. c", "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, "é\n", "fr", "b")]
    assert not differs(spark, tmp_path, "char_classes", documents=(rows, DOCUMENTS))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def small_model(spark):
    from langloom.operators.model import train

    rows = [(1, "en", "The quick brown fox. Another day"), (2, "de", "Der schnelle braune Fuchs. Ein Tag"), (3, "fr", "Le renard brun. Un jour")]
    return train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))


def test_texts_are_ranked_and_judged_where_they_are_read(spark):
    from langloom.operators import evaluate, scoring

    model = small_model(spark)
    texts = spark.createDataFrame([(1, "The fox", "en"), (2, "", "de"), (3, None, "fr"), (4, "Ein Fuchs", "xx")], "case_id long, text string, want string").repartition(8).localCheckpoint()
    for df in (scoring.classify(texts, model, "case_id"), scoring.classify_top(texts, model, "case_id"), evaluate.benchmark_misses(texts.where("text IS NOT NULL"), model)):
        assert "Exchange" not in plan(df) and "Join" not in plan(df) and "Sort [" not in plan(df)
    ranked = scoring.classify(texts, model, "case_id")
    by_rows = scoring.rank(scoring.score(scoring.terms(texts, model, "case_id")))
    key = lambda df: sorted((r.doc_id, r["rank"], r.lang_index, r.lang, r.score, round(r.confidence, 5)) for r in df.collect())
    assert key(ranked) == key(by_rows) and ranked.count() == 12


def test_split_shuffles_no_text(spark):
    from langloom.operators.split import split_keys, strided_split, with_split

    docs = spark.createDataFrame([(i, lang, f"t{i}") for lang, n in (("a", 90), ("b", 33), ("c", 2)) for i in range(n)], "doc_id long, lang string, text string")
    for most, held in ((20, 4), (7, 3), (1000, 10)):
        keys = split_keys(docs, ["doc_id"], most, held).localCheckpoint()
        rows = with_split(docs, keys, ["doc_id"], held)
        assert "SortMergeJoin" not in plan(rows) and "ShuffledHashJoin" not in plan(rows)
        key = lambda df: sorted((r.lang, r.doc_id, r.text, r.split) for r in df.collect())
        assert key(rows) == key(strided_split(docs, ["doc_id"], most, held))


def test_only_what_a_model_may_keep_is_sorted(spark):
    from langloom import constants as K
    from langloom.operators.model import candidates, totals

    rows = spark.range(40_000).selectExpr("'en' AS lang", f"{K.TOKEN_BIGRAM} AS section", "id AS key", "0 AS sub", "id + 1 AS cnt").unionByName(spark.range(3).selectExpr("'en' AS lang", f"{K.CLASS_PAIR} AS section", "id AS key", "0 AS sub", "1L AS cnt"))
    total, kept = candidates(rows)
    most = K.TOP_K[K.TOKEN_BIGRAM]
    assert {r.key for r in kept.where(f"section = {K.TOKEN_BIGRAM}").collect()} == set(range(40_000 - most, 40_000)) and kept.count() == most + 3
    assert sorted(total.collect()) == sorted(totals(rows).select(total.columns).collect())


def test_keys_that_wait_count_as_memory(monkeypatch):
    from langloom.operators import arrow_counts

    monkeypatch.setattr(arrow_counts, "MOST_KEYS", 200)
    counter = arrow_counts.Counter()
    for i in range(300):
        counter.add("en", [f"w{i}a x{i}b"])
        if counter.full():
            list(counter.flush())
        assert sum(len(k) for t in counter.by_lang.values() for k in t.keys.values()) <= 200
