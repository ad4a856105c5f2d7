import json

import pytest
from pyspark.sql import functions as F

from langloom import cli
from langloom.operators import evaluate, scoring
from langloom.operators.model import train
from langloom.operators.split import strided_split
from langloom.plans.jobs import run_benchmark, train_corpus
from langloom.sources import cases, modelfile, registry, text
from langloom.streaming import classify_stream, count_stream, streamed_counts

WORDS = {
    "en": "the river was cold and the children walked home with their mother after the long winter day",
    "de": "der Fluss war kalt und die Kinder gingen mit ihrer Mutter nach dem langen Wintertag nach Hause",
    "pl": "rzeka była zimna a dzieci wróciły z matką do domu po długim zimowym dniu przez las",
    "ja": "川は冷たくて、子どもたちは長い冬の日のあとで母と家に帰りました。",
}
PROBES = {"en": "the mother walked with the children", "de": "die Kinder gingen nach Hause", "pl": "dzieci wróciły do domu", "ja": "母と家に帰りました"}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i * 10 + j, lang, s) for i, (lang, s) in enumerate(WORDS.items()) for j in range(8)]
    return train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), languages=list(WORDS))


def test_the_right_language_with_confidence(spark, model):
    probes = spark.createDataFrame([(i, t) for i, t in enumerate(PROBES.values())], "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.classify_top(probes, model).collect()}
    assert [got[i].lang for i in range(4)] == list(PROBES) and all(r.confidence > 0.5 for r in got.values())
    assert scoring.classify(probes, model, max_out=2).count() == 8
    assert model.languages() == list(WORDS) and len(model) == 4 and model.find("xx") is None
    one = model.find("pl")
    assert one.languages() == ["pl"] and {r.lang for r in scoring.classify(probes, one).collect()} == {"pl"}
    assert model.get(1).languages() == ["de"]


def test_model_files(spark, model, tmp_path):
    paths = modelfile.write_files(model, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["en.lid", "de.lid", "pl.lid", "ja.lid", "combined.lid"]
    back = modelfile.read_file(spark, paths[-1]).written()
    assert back.languages() == list(WORDS)
    a, b = modelfile.long_form(model), modelfile.long_form(back)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    probes = spark.createDataFrame([(i, t) for i, t in enumerate(PROBES.values())], "doc_id long, text string")
    key = lambda m: sorted((r.doc_id, r.lang, r.score, r["rank"]) for r in scoring.classify(probes, m).collect())
    assert key(model) == key(back)
    blobs = {r.lang: bytes(r.blob) for r in modelfile.encode(model).collect()}
    again = {r.lang: bytes(r.blob) for r in modelfile.encode(model).collect()}
    assert blobs == again and all(len(x) < 300 * 1024 for x in blobs.values())
    whole = (tmp_path / "combined.lid").read_bytes()
    assert modelfile.parse_any(whole) == [blobs[c] for c in WORDS] and modelfile.find_file(spark, str(tmp_path)).endswith("/combined.lid")
    assert modelfile.read_file(spark, paths[1]).languages() == ["de"]
    (tmp_path / "combined.lid").unlink()
    assert modelfile.find_file(spark, str(tmp_path)).endswith("/de.lid") and modelfile.find_file(spark, "/nowhere", "x") == "x"
    with pytest.raises(FileNotFoundError):
        modelfile.find_file(spark, f"{tmp_path}/none")


def code(blob, parse=modelfile.parse_one):
    with pytest.raises(modelfile.ModelFileError) as e:
        parse(bytes(blob))
    return e.value.code


def test_broken_files_are_refused(model):
    blob = bytes(modelfile.encode(model).where("lang = 'en'").first().blob)
    flip = lambda i, b=blob: b[:i] + bytes([b[i] ^ 255]) + b[i + 1 :]
    assert code(blob[:200]) == "too_short" and code(flip(0)) == "bad_magic" and code(flip(4)) == "bad_version" and code(flip(100)) == "bad_checksum"
    assert code(flip(300)) == "bad_checksum" and code(blob[:-2]) == "truncated" and code(blob[:300]) == "bad_section"
    bundle = modelfile.encode_bundle([("en", blob)])
    assert modelfile.parse_bundle(bundle) == [blob] and code(bundle, modelfile.parse_one) == "bad_magic"
    assert code(bundle[:260], modelfile.parse_bundle) == "truncated" and code(bundle[:-1], modelfile.parse_bundle) == "bad_section" and code(flip(600, bundle), modelfile.parse_bundle) == "bad_checksum"


def test_text_sources(spark, tmp_path):
    nested = spark.createDataFrame([(1, ("a", "x")), (2, ("", "y")), (3, (None, "z")), (4, ("  ", "w"))], "id int, doc struct<text:string,other:string>")
    assert list(text.leaves(nested.schema)) == ["id", "doc.text", "doc.other"]
    assert [r.text for r in text.texts_of(nested).collect()] == ["a", "  "]
    assert text.texts_of(nested, "id").count() == 0
    with pytest.raises(ValueError, match="doc.other"):
        text.find_column(nested.schema, "none")
    nested.coalesce(1).write.parquet(f"{tmp_path}/n")
    assert [(r.text, r._row) for r in text.read_parquet_texts(spark, f"{tmp_path}/n").orderBy("_file", "_row").collect()] == [("a", 0), ("  ", 3)]
    (tmp_path / "en.txt").write_bytes("one line\r\n\n   \n  kept as is \nünicode\n".encode())
    assert [r.text for r in text.read_text_lines(spark, f"{tmp_path}/en.txt").collect()] == ["one line", "  kept as is ", "ünicode"]
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\n")
    with pytest.raises(Exception, match="(?i)utf"):
        text.read_text_lines(spark, f"{tmp_path}/bad.txt").collect()
    nested.write.parquet(f"{tmp_path}/de.parquet")
    (tmp_path / "de.txt").write_text("not read")
    rows = text.read_corpus(spark, str(tmp_path), ["de", "en"]).collect()
    assert sorted((r.lang, r.text) for r in rows if r.lang == "de") == [("de", "  "), ("de", "a")] and len(rows) == 5
    with pytest.raises(FileNotFoundError):
        text.read_corpus(spark, str(tmp_path), ["fr"])
    assert all("/n/" in f for f in text.list_parquet(spark, str(tmp_path), ["none/", "n/"])) and len(text.list_parquet(spark, str(tmp_path), [""])) > 1
    with pytest.raises(FileNotFoundError):
        text.list_parquet(spark, str(tmp_path), ["none/"])


def test_registry(spark):
    assert len(registry.LANGUAGES) == 29 and registry.resolve(["pl", "en", "pl"]) == ["pl", "en", "pl"] and registry.resolve([])[0] == "bg"
    with pytest.raises(ValueError, match="unknown lang code: qq"):
        registry.resolve(["qq"])
    assert registry.languages(spark, ["en"]).first().prefixes == ["sample/", "data/"] and registry.dataset_url("a/b", "c.parquet").endswith("a/b/resolve/main/c.parquet")


def test_cases(spark, tmp_path):
    rows = [{"text": "a", "lang": "en"}, {"sentence": "b", "label": "de"}, {"text": 1, "sentence": "x", "lang": "en"}, 5, {"content": "c", "expected": "pl", "language": "no"}, {"text": None, "lang": "en"}, {"lang": "en"}]
    (tmp_path / "a.json").write_text("\n  " + json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n   \n")
    want = [("a", "en"), ("b", "de"), ("c", "pl")]
    for name in ("a.json", "b.jsonl"):
        assert [(r.text, r.want) for r in cases.read_cases(spark, f"{tmp_path}/{name}").orderBy("case_id").collect()] == want
    (tmp_path / "c.jsonl").write_text('{"text": "a", "lang": "en"}\n{"text": \n')
    with pytest.raises(Exception, match="(?i)malformed|json"):
        cases.read_cases(spark, f"{tmp_path}/c.jsonl").collect()
    (tmp_path / "d.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        cases.read_cases(spark, f"{tmp_path}/d.jsonl")


def test_benchmark_job_and_reports(spark, model, tmp_path):
    modelfile.write_files(model, f"{tmp_path}/m")
    lines = [{"text": t, "lang": c} for c, t in PROBES.items()] + [{"text": "the\nmother " * 20, "lang": "zz"}]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = run_benchmark(spark, f"{tmp_path}/cases.jsonl", out_dir=f"{tmp_path}/m")
    report = [(r.want, r.ok, r.total) for r in got["report"].collect()]
    assert report == [("de", 1, 1), ("en", 1, 1), ("ja", 1, 1), ("pl", 1, 1), ("zz", 0, 1), (None, 4, 5)]
    miss = got["misses"].collect()
    assert len(miss) == 1 and miss[0].want == "zz" and len(miss[0].snippet) == 81 and miss[0].snippet.endswith("…") and "\n" not in miss[0].snippet


def test_training_job_and_split(spark, tmp_path):
    rows = [(i, lang, f"{s} {i}") for i in range(40) for lang, s in [list(WORDS.items())[i % 4]]]
    corpus = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model, report = train_corpus(corpus, ["doc_id"], list(WORDS), 6, 2, str(tmp_path))
    got = {r.lang: (r.lang_index, r.ok, r.total) for r in report.collect()}
    assert got == {"en": (0, 2, 2), "de": (1, 2, 2), "pl": (2, 2, 2), "ja": (3, 2, 2), "TOTAL": (None, 8, 8)}
    assert [r.docs for r in model.header.collect()] == [6] * 4 and {r.flags for r in model.header.collect()} == {0}
    none = evaluate.accuracy(spark.createDataFrame([], "doc_id long, lang_index int"), spark.createDataFrame([], "doc_id long, lang_index int"), model.header)
    assert {(r.ok, r.total) for r in none.collect()} == {(0, 0)}


def sequential(n, max_docs, eval_docs):
    stride, taken, held, since, out = max(1, max_docs // max(1, eval_docs)), 0, 0, 0, []
    for i in range(1, n + 1):
        if taken >= max_docs:
            break
        since += 1
        if held < eval_docs and since >= stride:
            since, held = 0, held + 1
            out.append((i, "eval"))
        else:
            taken += 1
            out.append((i, "train"))
    return out


@pytest.mark.parametrize(("n", "max_docs", "eval_docs"), [(20, 10, 3), (20, 10, 0), (50, 7, 7), (9, 100, 10), (60, 5, 50), (30, 1, 1)])
def test_split_like_a_sequential_scan(spark, n, max_docs, eval_docs):
    df = spark.range(1, n + 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    got = [(r.position, r.split) for r in strided_split(df, ["doc_id"], max_docs, eval_docs).orderBy("position").collect()]
    assert got == sequential(n, max_docs, eval_docs)


def test_streams(spark, model, tmp_path):
    source = f"{tmp_path}/in"
    for k, (lang, s) in enumerate(WORDS.items()):
        spark.createDataFrame([(k, lang, s)], "doc_id long, lang string, text string").write.mode("append").parquet(source)
    stream = spark.readStream.schema("doc_id long, lang string, text string").option("maxFilesPerTrigger", 2).parquet(source)
    q = classify_stream(stream.select("doc_id", "text"), model, f"{tmp_path}/out", f"{tmp_path}/c1")
    q.processAllAvailable()
    q.stop()
    assert [r.lang for r in spark.read.parquet(f"{tmp_path}/out").orderBy("doc_id").collect()] == list(WORDS)
    q = count_stream(stream, f"{tmp_path}/counts", f"{tmp_path}/c2")
    q.processAllAvailable()
    q.stop()
    from langloom.operators.counts import train_counts

    whole, parts = train_counts(spark.read.parquet(source)), streamed_counts(spark, f"{tmp_path}/counts")
    assert whole.counts.exceptAll(parts.counts.select(whole.counts.columns)).isEmpty() and whole.stats.exceptAll(parts.stats).isEmpty()


def test_cli(spark, tmp_path, capsys):
    for lang, s in WORDS.items():
        (tmp_path / f"{lang}.txt").write_text("\n".join(f"{s} {i}" for i in range(6)))
    cli.main(["--langs", ",".join(WORDS), "--from-text", str(tmp_path), "--out-dir", f"{tmp_path}/m", "--max-docs", "4", "--eval-docs", "1"])
    assert "TOTAL" in capsys.readouterr().out and (tmp_path / "m/combined.lid").exists()
    (tmp_path / "cases.json").write_text(json.dumps([{"text": t, "lang": c} for c, t in PROBES.items()]))
    cli.main(["--benchmark", f"{tmp_path}/cases.json", "--out-dir", f"{tmp_path}/m"])
    assert "4 cases" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main([])


def test_cli_reads_listed_datasets(spark, tmp_path, capsys):
    """A mirror of the datasets: the first prefix that has files, in the order of their names; the cache goes unless it is to stay."""
    repos = {c: (r, p) for c, r, p in registry.LANGUAGES}
    for lang in ("en", "de"):
        repo, prefixes = repos[lang]
        for k in range(2):
            rows = [(f"{WORDS[lang]} {k}{i}",) for i in range(5)]
            spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{tmp_path}/hub/{repo}/{prefixes[-1]}part{k}.parquet")
    rows = text.read_listed_corpus(spark, f"{tmp_path}/hub", ["de"]).orderBy(*text.SCAN_ORDER).collect()
    assert [r.text for r in rows] == [f"{WORDS['de']} {k}{i}" for k in range(2) for i in range(5)]
    args = ["--langs", "en,de", "--corpus-root", f"{tmp_path}/hub", "--out-dir", f"{tmp_path}/m", "--max-docs", "6", "--eval-docs", "2"]
    cli.main(args)
    assert "TOTAL" in capsys.readouterr().out and (tmp_path / "m/combined.lid").exists() and not list((tmp_path / "m/.cache").iterdir())
    cli.main([*args, "--leave-files", "--cache-dir", f"{tmp_path}/cache"])
    assert len(list((tmp_path / "cache").iterdir())) == 1
    cli.main([*args, "--no-cache"])
    with pytest.raises(FileNotFoundError):
        text.read_listed_corpus(spark, f"{tmp_path}/hub", ["fr"])


def test_line_files_keep_their_order(spark, tmp_path):
    (tmp_path / "en.txt").write_text("\n".join(f"line {i}" if i % 3 else "" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.read_corpus(spark, str(tmp_path), ["en"]).orderBy(*text.SCAN_ORDER).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.text for r in rows] == [f"line {i}" for i in range(3000) if i % 3]


def test_api_names():
    import langloom

    assert langloom.classify is scoring.classify and all(callable(getattr(langloom, n)) for n in langloom.__all__ if n != "VERSION")
    with pytest.raises(AttributeError):
        langloom.nothing


def test_many_languages_in_groups(spark, model, monkeypatch):
    from langloom.operators import scoring

    probes = spark.createDataFrame([(i, t) for i, t in enumerate(PROBES.values())], "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.lang, r["rank"], r.score) for r in df.collect())
    whole = key(scoring.classify(probes, model))
    monkeypatch.setattr(scoring, "GROUP", 3)
    assert key(scoring.classify(probes, model)) == whole == key(scoring.classify(probes, model, by_columns=True))
