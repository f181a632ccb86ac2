"""Readers and writers on literal files."""

import json

import pytest
from pyspark.sql import functions as F

from quaero.functions.text import simple_tokens
from quaero.operators import index
from quaero.sources import readers, sinks
from quaero.streaming import serving


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(p)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_papers_and_corpus(spark, tmp_path):
    p = put(tmp_path, "c.json", [{"pubkey": 1, "title": " A ", "abstract": "b"}, {"cord_uid": "x", "title": "", "abstract": None}, {"title": "no id"}, {"pubkey": 1, "title": "Z", "abstract": ""}])
    d = readers.papers(spark, p)
    assert rows(d, "docid") == [("1",), ("1",), ("x",)]
    assert rows(readers.corpus(d), "docid", "text") == [("1", "A b")]
    with pytest.raises(ValueError):
        readers.corpus(d.where("docid = 'x'"))


def test_queries(spark, tmp_path):
    p = put(tmp_path, "expanded_queries_en.json", [{"index": 7, "text": "t", "original": " ", "expanded": "e", "pubkey": 9, "extra": {}}, {"qid": "b", "text": ""}])
    assert rows(readers.queries(spark, p), "qid", "query", "gold", "language") == [("7", "e", "9", "en")]
    with pytest.raises(ValueError):
        readers.queries(spark, p, strict=True)
    m = put(tmp_path, "m.json", {"a": "one", "b": {"text": "two"}, "c": {}})
    assert rows(readers.query_map(spark, m), "qid", "query") == [("a", "one"), ("b", "two")]


def test_runs(spark, tmp_path):
    a = put(tmp_path, "a.json", {"q": ["d1", "d2", "d1"], "r": {"x": 0.2, "y": 0.9, "z": {"rank": "1", "score": 0.1}}})
    got = rows(readers.read_run(spark, a, "s"), "qid", "docid", "rank")
    assert got == [("q", "d1", 1), ("q", "d2", 2), ("r", "x", 3), ("r", "y", 2), ("r", "z", 1)]
    t = put(tmp_path, "t.txt", "# c\n\nq Q0 d2 1 0.5 tag\nq Q0 d1 2 0.4 tag\nr d9 1 0.3\nu d7\nu d8\n")
    assert rows(readers.read_run(spark, t, "s"), "qid", "docid", "rank") == [("q", "d1", 2), ("q", "d2", 1), ("r", "d9", 1), ("u", "d7", 1), ("u", "d8", 2)]
    j = put(tmp_path, "j.jsonl", '{"query_id": 3, "document_id": "d", "similarity": "0.5"}\n{"query_id": 3, "docno": "e", "value": 0.7}\n')
    assert rows(readers.read_run(spark, j, "s"), "qid", "docid", "rank") == [("3", "d", 2), ("3", "e", 1)]
    assert readers.discover_runs(spark, str(tmp_path)).count() == 1


def test_small_files(spark, tmp_path):
    q = put(tmp_path, "q.json", {"a": {"d": 1}})
    assert rows(readers.qrels(spark, q), "qid", "docid", "relevance") == [("a", "d", 1)]
    assert readers.stopwords(spark, put(tmp_path, "s.txt", "# x\n The \n\nand\n")) == ["and", "the"]
    assert readers.stopwords(spark, str(tmp_path / "none.txt")) == []
    g = put(tmp_path, "g.tsv", "post_id\ttweet_text\tcord_uid\n1\thi there\tx\n")
    assert rows(readers.ground_truth_tsv(spark, g), "qid", "query", "gold") == [("1", "hi there", "x")]
    d = put(tmp_path, "d.json", {"w": [{"term": "v", "score": 0.7}]})
    assert readers.dictionary(spark, d).first().synonyms[0].term == "v"
    c = put(tmp_path, "t.json", {"en->fr": {"a": "b"}})
    assert rows(readers.translation_cache(spark, c), "direction", "source", "target") == [("en->fr", "a", "b")]
    m = put(tmp_path, "m.json", {"per_query": [{"qid": "a", "first_relevant_rank": 1, "mrr@5": 1.0, "precision@1": 1.0, "hit@1": 1.0}]})
    assert rows(readers.metric_rows(spark, m, ["mrr@5", "f1@1"], "s"), "metric", "score") == [("f1@1", 1.0), ("mrr@5", 1.0)]
    bad = put(tmp_path, "bad.jsonl", '{"a": "1"}\n{oops\n')
    assert sum(r._corrupt_record is not None for r in readers.json_lines(spark, bad, "a string", strict=False).collect()) == 1


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([("s", "q", f"d{i}", i) for i in range(1, 8)], "system string, qid string, docid string, rank int")
    assert sinks.submission_rows(run).first().preds == "[d1, d2, d3, d4, d5]"
    sinks.write_rankings_json(run, str(tmp_path / "r"))
    line = spark.read.text(str(tmp_path / "r")).first().value
    assert json.loads(line)["q"][0] == "d1"
    sinks.write_json_lines(run.withColumn("_x", F.lit(1)), str(tmp_path / "jl"))
    assert "_x" not in spark.read.json(str(tmp_path / "jl")).columns
    assert not sinks.write_csv(run.limit(0), str(tmp_path / "none"))
    sinks.write_submission(run, str(tmp_path / "sub"))
    sinks.write_run(run, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run")).count() == 7
    f = tmp_path / "x.json"
    f.write_text("")
    assert sinks.free_name(str(f)).endswith("x_1.json") and sinks.default_output("a/b.json") == "a/b_eval.json"
    assert "d1" in sinks.report(spark, "T", {"run": run})
    assert spark.createDataFrame([("12",), ("a1",)], "i string").select(sinks.export_id(F.col("i")).alias("i")).collect()[0].i == 12


def test_query_stream(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "red fox"), ("d2", "blue dog")], "docid string, t string")
    fields = {"t": simple_tokens("t")}
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.json", '{"qid": "q", "query": "fox"}\n')
    s = serving.score_stream(serving.query_files(spark, str(tmp_path / "in")), index.postings(docs, "docid", fields), index.field_statistics(docs, fields), simple_tokens("query"), str(tmp_path / "out"), str(tmp_path / "ck"))
    s.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "qid", "docid") == [("q", "d1")]


def test_training_rows_and_filters(spark, tmp_path):
    p = put(tmp_path, "t.jsonl", '{"qid": "1", "query": " q ", "pos": ["a"], "neg": ["b", " "], "hard_neg": ["c"]}\n{"qid": "2", "query": "r", "positive": "p", "negatives": ["n"]}\n')
    got = {r.qid: r for r in readers.training_rows(spark, p).collect()}
    assert got["1"].neg == ["b"] and got["1"].hard_neg == ["c"] and got["2"].pos == ["p"] and got["2"].neg == ["n"] and got["2"].query == "r"
    with pytest.raises(ValueError):
        readers.training_rows(spark, put(tmp_path, "u.jsonl", '{"qid": "1", "query": "q", "pos": []}\n'))
    f = spark.createDataFrame([('heart risk venue:"The Lancet" author: A. Smith',), ("plain",), ("x venue:bmj",)], "t string").select(readers.search_filters(F.col("t")).alias("f")).collect()
    assert [tuple(r.f) for r in f] == [("heart risk", "the lancet", "a. smith"), ("plain", None, None), ("x", "bmj", None)]
    c = spark.createDataFrame([("a", None), ("a", "a"), ("a", "b")], "x string, y string").select(readers.compatible(F.col("x"), F.col("y")).alias("c")).collect()
    assert [r.c for r in c] == [True, True, False]


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quaero import session

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None, master="spark://a:7077")
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(sparkContext=sc))
    t = session.written(spark.range(5), "t")
    files = t.inputFiles()
    assert t.count() == 5 and session.drop_written(spark) >= 1
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_shapes_and_missing_files(spark, tmp_path):
    a = put(tmp_path, "a.json", [{"qid": "1", "text": "x"}])
    b = put(tmp_path, "b.json", {"1": "x", "2": {"text": "y"}})
    c = put(tmp_path, "c.json", {"1": ["d"], "2": []})
    d = put(tmp_path, "d.jsonl", '{"qid": "1", "text": "x"}\n{"qid": "2", "text": "y"}\n')
    e = put(tmp_path, "e.json", "")
    assert [readers.shape(spark, p) for p in (a, b, c, d)] == ["records", "map of values", "map of lists", "lines"]
    assert rows(readers.any_queries(spark, a), "qid", "query") == [("1", "x")] and readers.any_queries(spark, b).count() == readers.any_queries(spark, d).count() == 2
    with pytest.raises(ValueError):
        readers.shape(spark, e)
    with pytest.raises(FileNotFoundError):
        readers.existing(spark, [a, e])
    with pytest.warns(UserWarning):
        assert readers.existing(spark, [a, str(tmp_path / "none.json")], needed=False) == [a]
    q = spark.createDataFrame([("3", "c", 1), ("1", " ", 0), ("2", "b", 2)], "qid string, query string, n int")
    assert rows(readers.first_queries(q, 1, "q: ", "n"), "qid", "query") == [("3", "q: c")]
    assert readers.query_ids(q).count() == 3
    with pytest.raises(ValueError):
        readers.query_ids(q.limit(0))
    assert readers.discover_inputs(str(tmp_path), outputs=("a",)) == [b, c, e]


def test_bad_lines_have_numbers(spark, tmp_path):
    p = put(tmp_path, "x.jsonl", '{"a": "1"}\n' * 41 + "{oops\n" + '{"a": "1"}\n' * 3 + "[1\n")
    assert [(r.line, r.value) for r in readers.bad_lines(spark, p).orderBy("line").collect()] == [(42, "{oops"), (46, "[1")]
    with pytest.raises(ValueError, match="line 42: {oops"):
        readers.json_lines(spark, p, "a string")
    assert readers.json_lines(spark, put(tmp_path, "y.jsonl", '{"a": "1"}\n'), "a string").columns == ["a"]


def test_first_text_of_an_id_and_caches(spark, tmp_path):
    d = spark.createDataFrame([("1", "", "", 0), ("1", "z", "", 1), ("1", "a", "", 2)], "docid string, title string, abstract string, n int")
    assert rows(readers.corpus(d, order="n"), "text") == [("z",)] and rows(readers.corpus(d), "text") == [("a",)]
    for bad in ({"x": "y"}, {"x": {"a": None}}, ["a"]):
        with pytest.raises(ValueError):
            readers.translation_cache(spark, put(tmp_path, "t.json", bad))
    assert readers.seen_trials(spark, str(tmp_path / "none"), ["w"]).count() == 0
    sinks.append_trial(spark.createDataFrame([(0.5, 0.1)] * 2, "w double, v double"), str(tmp_path / "trials"))
    assert rows(readers.seen_trials(spark, str(tmp_path / "trials"), ["w", "v"]), "w", "v") == [(0.5, 0.1)]


def test_checked_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", "x"), ("2", " ")], "qid string, text string")
    with pytest.raises(ValueError):
        sinks.write_checked_json(df, str(tmp_path / "a"), ["text"])
    assert not (tmp_path / "a").exists() and sinks.write_checked_json(df, str(tmp_path / "a"), ["qid"]) == 2
    assert sinks.export_set({"q": df, "e": df.limit(0)}, str(tmp_path / "set")) == {"q": 2, "e": 0}
    assert spark.read.json(str(tmp_path / "set/summary")).count() == 2
    run = spark.createDataFrame([("s", "q", f"d{i}", i) for i in range(1, 8)], "system string, qid string, docid string, rank int")
    assert json.loads(sinks.rankings_object(run, 2)) == {"q": ["d1", "d2"]}
    with pytest.raises(ValueError):
        sinks.rankings_object(run, 2, limit=0)
    cov = spark.createDataFrame([("s", 2, 1, 0.5)], "system string, ranking_qids int, matched_qids int, coverage double")
    m = sinks.manifest(cov, F.lit("x/dev_set/run_fr_dev.json")).first()
    assert (m.split, m.language, m.coverage) == ("dev", "fr", "0.500000")
    per = spark.createDataFrame([("s", "q", 1.0), ("t", "q", 0.0)], "system string, qid string, ap double")
    totals = spark.createDataFrame([("s", 1, 1.0)], "system string, queries int, ap double")
    assert {r.kind for r in sinks.metrics_document(per, totals, "s", with_queries=True).collect()} == {"metrics", "per_query"}


def test_exact_keys(spark):
    from quaero.operators import quality

    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1}',), ('{"a": 1, "b": 2, "c": 3}',), ("no",), ('{"a": "q", "b": 1}',)], "value string")
    assert sorted(r.issue for r in quality.exact_keys(df, ["a", "b"], "a").collect()) == ["missing key", "no object", "no whole number", "unknown key"]
