"""Operators against brute force on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.functions.text import simple_tokens
from quaero.functions.vectors import max_sim, unit
from quaero.operators import dense, fusion, index, metrics, quality, rerank, training


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d1", "red fox", "the quick red fox jumps"), ("d2", "blue dog", "a lazy blue dog sleeps near the red barn"), ("d3", "", None), ("d4", "fox fox", "fox")]
    return spark.createDataFrame(rows, "docid string, title string, abstract string")


def fields():
    return {"title": simple_tokens("title"), "abstract": simple_tokens("abstract")}


def brute_bm25(docs, words):
    out = {}
    for f in (1, 2):
        toks = {d[0]: [t for t in (d[f] or "").split() if t not in ("the", "a")] for d in docs}
        n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
        for w in words:
            df = sum(w in t for t in toks.values())
            for d, t in toks.items():
                tf = t.count(w)
                if tf:
                    out[d] = out.get(d, 0) + math.log1p((n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return out


def test_bm25(spark, docs):
    q = spark.createDataFrame([("q1", "red fox"), ("q2", "zebra"), ("q3", "the"), ("q4", "")], "qid string, query string")
    got = index.bm25_scores(index.query_terms(q, "qid", simple_tokens("query")), index.postings(docs, "docid", fields()), index.field_statistics(docs, fields()))
    rows = {r.docid: r.score for r in got.collect()}
    want = brute_bm25([tuple(r) for r in docs.collect()], ["red", "fox"])
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-8 for k in want)
    assert {r.qid for r in got.collect()} == {"q1"}


def test_dense_blocks_and_broadcast_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    a = {tuple(r) for r in dense.dense_topk(df, df, "id", "v", 5).collect()}
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(dense, "QUERIES_IN_BLOCK", 16)
    b = {tuple(r) for r in dense.dense_topk(df, df, "id", "v", 5).collect()}
    m = np.array([r[1] for r in rows[:-1]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    assert a == b and all({r[1] for r in a if r[0] == i} == set(np.argsort(-s[i])[:5].tolist()) for i in range(60))


def test_late_interaction(spark):
    df = spark.createDataFrame([("q", "d", [[1.0, 0.0], [0.0, 1.0]], [[0.6, 0.8], [1.0, 0.0]])], "qid string, docid string, a array<array<double>>, b array<array<double>>")
    got = dense.late_interaction(df.select("qid", "docid"), df.select("qid", F.col("a").alias("tokens")), df.select("docid", F.col("b").alias("tokens"))).first().score
    assert got == pytest.approx(0.9) and df.select(max_sim(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.9)
    assert spark.range(1).select(unit(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]


def test_hybrid_needs_a_weight(spark):
    e = spark.createDataFrame([], "qid string, docid string, score double")
    with pytest.raises(ValueError):
        dense.hybrid(e, e, e, 5, (0, 0, 0))


@pytest.fixture(scope="module")
def entries(spark):
    rows = [("s", "q", " d1 ", 2, 0.5), ("s", "q", "d1", 1, 0.4), ("s", "q", "d2", None, float("nan")), ("s", "q", "", 1, 1.0), ("s", "q", None, 1, 1.0), ("s", "q", "d3", 0, 0.9), ("t", "q", "d3", 1, None), ("t", "r", "d9", 5, 0.1)]
    return spark.createDataFrame(rows, "run_name string, qid string, docid string, rank int, score double")


def test_normal_run(entries):
    got = [(r.system, r.qid, r.docid, r.rank, r.score) for r in fusion.normal_run(entries).orderBy("system", "qid", "rank").collect()]
    assert got == [("s", "q", "d1", 1, 0.5), ("s", "q", "d3", 2, 0.9), ("s", "q", "d2", 3, None), ("t", "q", "d3", 1, None), ("t", "r", "d9", 1, 0.1)]


def test_rrf_order(entries):
    f = fusion.reciprocal_rank_fusion(fusion.normal_run(entries)).where("qid = 'q'").orderBy("place").collect()
    assert [r.docid for r in f] == ["d3", "d1", "d2"] and f[0].support == 2 and f[0].rrf == pytest.approx(1 / 61 + 1 / 62)


def test_metrics_cut_offs(spark):
    ranks = {"a": 1, "b": 5, "c": 6, "d": 10, "e": 11, "f": 100, "g": 101}
    run = spark.createDataFrame([("s", q, "gold", r) for q, r in ranks.items()], "system string, qid string, docid string, rank int")
    golds = spark.createDataFrame([(q, "gold") for q in [*ranks, "none"]], "qid string, docid string")
    grid = spark.createDataFrame([("s", q) for q in [*ranks, "none", "nogold"]], "system string, qid string")
    per = {r.qid: r for r in metrics.per_query(run, golds, grid).collect()}
    assert [per[q].recall_5 for q in "abcdefg"] == [1, 1, 0, 0, 0, 0, 0] and per["g"].recall_100 == 0 and per["f"].recall_100 == 1
    assert per["a"].precision_10 == 0.1 and per["b"].mrr_5 == 0.2 and per["c"].mrr_5 == 0 and per["e"].ap == pytest.approx(1 / 11)
    assert per["none"].first_rank == -1 and per["nogold"].ap == 0 and per["d"].ndcg_10 == pytest.approx(1 / math.log2(11))
    agg = metrics.aggregate(metrics.per_query(run, golds, grid)).first()
    assert agg.queries == 9 and agg.f1_1 == pytest.approx(1 / 9)


def test_rerank_missing(spark):
    run = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("s", "q", "x", 3), ("s", "z", "b", 1), ("s", "z", "a", 2)], "system string, qid string, docid string, rank int")
    q = spark.createDataFrame([("q", "red fox")], "qid string, query string")
    d = spark.createDataFrame([("a", "blue dog"), ("b", "red fox den")], "docid string, text string")
    keep = {(r.qid, r.docid): r.rank for r in rerank.rerank(run, q, d).collect()}
    assert keep == {("q", "b"): 1, ("q", "a"): 2, ("z", "b"): 1, ("z", "a"): 2}
    assert {r.qid for r in rerank.rerank(run, q, d, on_missing="drop").collect()} == {"q"}
    model = rerank.model_scorer(lambda a, b: [float(len(t)) for t in b])
    assert rerank.rerank(run, q, d, model, k=1).where("qid = 'q'").first().docid == "b"


def test_split_sizes_and_no_leak(spark):
    q = spark.createDataFrame([(f"q{i % 50}",) for i in range(100)], "qid string")
    s = training.split_by_query(q).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 40, "dev": 5, "test": 5}
    with pytest.raises(ValueError):
        training.split_by_query(q, train=0.9, dev=0.2)


def test_offset_negatives_fall_back(spark):
    rows = [("s", "q", f"d{i:02}", i) for i in range(1, 8)] + [("s", "few", f"d{i:02}", i) for i in range(1, 5)]
    run = spark.createDataFrame(rows, "system string, qid string, docid string, rank int")
    gold = spark.createDataFrame([("q", "d01")], "qid string, docid string")
    corpus = spark.createDataFrame([(f"d{i:02}",) for i in range(1, 8)], "docid string")
    c = training.candidate_negatives(run, gold, corpus)
    n = training.offset_negatives(c, (1, 4), (5, 2)).orderBy("pos").collect()
    assert {r.qid for r in n} == {"q"} and [r.docid for r in n if r.kind == "hard"] == ["d03", "d04", "d05", "d06"]
    assert [r.docid for r in n if r.kind == "soft"] == ["d07"]


def test_fused_negatives_are_unique_by_text(spark):
    run = spark.createDataFrame([("s", "q", d, i) for i, d in enumerate(["a", "b", "c", "g"], 1)], "system string, qid string, docid string, rank int")
    texts = spark.createDataFrame([("a", "Same  text"), ("b", "same text"), ("c", "GOLD"), ("g", "gold"), ("z", "fill")], "docid string, text string")
    gold = spark.createDataFrame([("q", "g")], "qid string, docid string")
    fill = spark.createDataFrame([("q", "z"), ("q", "a")], "qid string, docid string")
    got = training.fused_negatives(run, gold, texts, 5, fill=fill).orderBy("place").collect()
    assert [(r.docid, r.stage) for r in got] == [("a", 1), ("z", 2)]


def test_quality(spark):
    g = spark.createDataFrame([("q", "a", 1), ("q", "a", 0), ("r", "b", 0)], "qid string, docid string, label int")
    t = spark.createDataFrame([("a", "one two three four five six"), ("b", "x")], "docid string, text string")
    assert {tuple(r) for r in quality.violations(g, t).collect()} == {("r", "no positive"), ("q", "document twice"), ("q", "positive as negative"), ("r", "short texts")}
    with pytest.raises(ValueError, match="label: 2 rows"):
        quality.check(g, {"label": "label = 1"})
    quality.check(g, {"label": "label in (0, 1)"})


def test_empty_run(spark):
    e = spark.createDataFrame([], "run_name string, qid string, docid string, rank int, score double")
    assert fusion.normal_run(e).count() == 0 and fusion.reciprocal_rank_fusion(fusion.normal_run(e)).count() == 0


def test_augmentation(spark):
    from quaero.operators import augmentation as a

    cache = spark.createDataFrame([("x", "a", "A")], "direction string, source string, target string")
    req = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", " "), ("x", "b")], "direction string, source string")
    assert [tuple(r) for r in a.cache_misses(req, cache).collect()] == [("x", "b")]
    assert {(r.source, r.target) for r in a.translated(req, cache).collect()} == {("a", "A"), ("b", None), (" ", None)}
    f = spark.createDataFrame([("un", "one"), ("le", "the")], "source string, target string")
    b = spark.createDataFrame([("one", "un un"), ("the", "LE ")], "source string, target string")
    assert [tuple(r) for r in a.back_translations(f.selectExpr("source as text"), f, b).collect()] == [("un", "un un")]
    g = spark.createDataFrame([("q", "p", 1), ("q", "n", 0), ("r", "s", 1)], "qid string, docid string, label int")
    assert {tuple(r) for r in a.topped_up(g, 2).collect()} == {("q", "n", "own"), ("q", "s", "other"), ("r", "p", "other")}
    assert a.capped_sample(g, "qid", 1).count() == 1


def test_small_training_helpers(spark):
    q = spark.createDataFrame([("a", "d1"), ("b", "gone"), ("c", None)], "qid string, gold string")
    qrels = spark.createDataFrame([("b", "d2", 1), ("b", "d1", 0), ("c", "gone", 1)], "qid string, docid string, relevance int")
    corpus = spark.createDataFrame([("d1",), ("d2",)], "docid string")
    assert {tuple(r) for r in training.gold_of(q, qrels, corpus).collect()} == {("a", "d1"), ("b", "d2")}
    e = spark.createDataFrame([("a", "d1"), ("a", "d1")], "qid string, docid string")
    assert {r.qid for r in training.union_editions({"2025": e, "2026": e}).collect()} == {"2025_a", "2026_a"}
    run = spark.createDataFrame([("s", "a", "d2", 1), ("s", "a", "d1", 2), ("t", "a", "d3", 1), ("t", "a", "d2", 2)], "system string, qid string, docid string, rank int")
    got = training.first_come_negatives(run, e, ["t", "s"], 5).orderBy("place").collect()
    assert [r.docid for r in got] == ["d3", "d2"]
    assert training.used_at_most(spark.createDataFrame([(f"q{i}", "d") for i in range(9)], "qid string, docid string"), 4).count() == 4
    assert sorted(r["index"] for r in training.sequential_index(run, ["system", "docid"]).collect()) == [0, 1, 2, 3]
    bad = spark.createDataFrame([(0, "x"), (0, " "), (7, "y")], "index int, text string")
    assert {tuple(r) for r in quality.exact_records(bad, ["text"]).collect()} == {(0, "blank text"), (0, "repeated index"), (7, "index outside")}
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, docid string, rank int")
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y z w")], "docid string, t string")
    assert index.first_tokens(hits, docs, "t", "docid", 3).first().terms == ["x", "y", "z"]


@pytest.mark.parametrize("queries", [3, 46, 200])
def test_groups_are_topped_up_as_far_as_positives_go(spark, queries):
    """Whatever the number of positives, a group is full or holds every positive of the others."""
    from quaero.operators import augmentation as a

    rows = [(f"q{i}", f"p{i}", 1) for i in range(queries)] + [("q0", f"p{i}", 0) for i in range(1, queries, 2)] + [("q1", f"n{i}", 0) for i in range(5)]
    got = a.topped_up(spark.createDataFrame(rows, "qid string, docid string, label int"), 12).collect()
    assert len({(r.qid, r.docid) for r in got}) == len(got) and not {(r.qid, r.docid) for r in got if r.source == "other"} & {x[:2] for x in rows}
    for i in range(queries):
        own = sum(x[0] == f"q{i}" and x[2] == 0 for x in rows)
        free = queries - 1 - (own if i == 0 else 0)
        assert sum(r.qid == f"q{i}" for r in got) == max(own, min(12, own + free)), i


def test_random_negatives_are_always_n(spark):
    """Small corpora, many golds: n wherever the corpus has so many that are no positives."""
    for docs_, golds_ in ((3, 0), (12, 9), (40, 30), (300, 5)):
        corpus = spark.createDataFrame([(f"d{i}",) for i in range(docs_)], "docid string")
        q = spark.createDataFrame([(f"q{i}",) for i in range(30)], "qid string")
        g = spark.createDataFrame([(f"q{i}", f"d{(i + j) % docs_}") for i in range(30) for j in range(golds_)], "qid string, docid string")
        rows = [tuple(r) for r in training.random_negatives(q, corpus, g, 5).collect()]
        own = {tuple(r) for r in g.collect()}
        assert len(set(rows)) == len(rows) and not own & set(rows)
        assert all(sum(r[0] == f"q{i}" for r in rows) == min(5, docs_ - golds_) for i in range(30))


def test_filled_negatives(spark):
    run = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("t", "q", "b", 1)], "system string, qid string, docid string, rank int")
    # Half of the corpus has the positive's text: the first draws are not enough.
    texts = spark.createDataFrame([(d, d) for d in "ab"] + [(f"x{i}", "gold" if i % 2 else f"text {i}") for i in range(60)] + [("g", "gold")], "docid string, text string")
    gold = spark.createDataFrame([("q", "g"), ("r", "g")], "qid string, docid string")
    queries = spark.createDataFrame([("q",), ("r",), (None,)], "qid string")
    base = spark.createDataFrame([("q", "x2", 1), ("q", "x1", 2)], "qid string, docid string, pos int")
    got = training.filled_negatives(queries, run, gold, texts, 20, base=base).collect()
    for q in "qr":
        mine = sorted((r for r in got if r.qid == q), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, 21)) and len({r.docid for r in mine}) == 20 and not any(r.docid[1:].isdigit() and int(r.docid[1:]) % 2 for r in mine)
    assert [(r.docid, r.stage, r.support) for r in sorted((r for r in got if r.qid == "q"), key=lambda r: r.place)[:3]] == [("b", 1, 2), ("a", 1, 1), ("x2", 2, None)]
    few = training.filled_negatives(queries, run, gold, texts.where("docid in ('a', 'b', 'g', 'x2')"), 20).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in few} == {"q": 3, "r": 3}


def test_gates(spark):
    neg = spark.createDataFrame([("q", "a", 1, 2), ("q", "b", 3, None), ("r", "c", 3, None)], "qid string, docid string, stage int, support bigint")
    m = quality.build_quality(neg, 2, runs=2, per_run=1)
    r = m.first()
    assert (r.rows, r.capacity_per_row, r.least_fallback, r.avg_selected, r.rows_with_run, r.rows_only_fallback, r.rows_underfilled, r.rows_with_overlap_negatives) == (2, 2, 0, 1.5, 0.5, 0.5, 0.5, 0.5)
    with pytest.raises(ValueError, match="50.0% of the rows are short"):
        quality.require_quality(m)
    with pytest.raises(ValueError, match="have a run negative.*fallback only"):
        quality.require_quality(m, least_with_run=0.9, most_only_fallback=0.1)
    quality.require_quality(quality.build_quality(neg.where("qid = 'q'"), 2))
    run = spark.createDataFrame([("s", "q", "a", 1), ("t", "z", "a", 1), ("u", "q", "g", 1)], "system string, qid string, docid string, rank int")
    q, c, g = spark.createDataFrame([("q",), ("r",)], "qid string"), spark.createDataFrame([("a",), ("g",)], "docid string"), spark.createDataFrame([("q", "g")], "qid string, docid string")
    a = quality.alignment(run, q, c, g)
    with pytest.raises(ValueError, match="t has none of the 2 queries; u has no usable candidate"):
        quality.require_runs(a, 2)
    with pytest.raises(ValueError, match="less than 90.0%"):
        quality.require_runs(a.where("system = 's'"), 2, least_overlap=0.9)
    quality.require_runs(a.where("system = 's'"), 2, 0.5, 0.5)
    st = training.negative_statistics(run.select("qid", "docid", "rank"), run.where("system = 's'"))
    assert st.first().overlap == 1 and len(quality.coverage_warnings(st, 10, 5)) == 2 and quality.coverage_warnings(st, 10, 9, least_rank=0) == []
    groups = spark.createDataFrame([("q", "a", 1), ("q", "b", 0), ("q", "c", 0), ("q", "x", 0)], "qid string, docid string, label int")
    texts = spark.createDataFrame([("a", "One text of six whole words"), ("b", "one  TEXT of six whole words"), ("c", "another text with six whole words"), ("x", " ")], "docid string, text string")
    assert {r.issue for r in quality.violations(groups, texts, 3.0, n=2).collect()} == {"text of a positive", "no text", "wrong number of negatives"}


def test_metric_helpers(spark):
    s = spark.createDataFrame([("q", "a", 1, 0.1), ("q", "b", 0, 0.5), ("r", "c", 1, 1.0), ("t", "d", 1, 0.5), ("t", "e", 0, 0.5)], "qid string, docid string, label int, score double")
    assert tuple(metrics.candidate_mrr(s).first()) == (2, 1, 0.75)
    assert [metrics.metric_name(n) for n in ("MRR@5", "map", "nDCG@10", "recall-100")] == ["mrr_5", "ap", "ndcg_10", "recall_100"]
    with pytest.raises(ValueError):
        metrics.metric_name("bleu")
    a = spark.createDataFrame([("x", 0.5), ("y", 1.0)], "metric string, value double")
    assert {tuple(r) for r in metrics.metric_delta(a, a.where("metric = 'x'").selectExpr("metric", "value + 0.1 as value")).collect()} == {("x", 0.5, 0.6, 0.1), ("y", 1.0, None, None)}
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, docid string, rank int")
    assert [r.score for r in metrics.synthetic_scores(run, 10).orderBy("rank").collect()] == [10.0, 9.0]
    assert dense.query_prefix("BAAI/bge-m3") == "" and dense.query_prefix("BAAI/bge-large").startswith("Represent") and dense.query_prefix("x", "p") == "p"
    assert dense.valid_positions(spark.createDataFrame([(-1,), (0,), (4,), (5,)], "position int"), 5).count() == 2
    groups = spark.createDataFrame([("q", "p", 1), ("q", "a", 0), ("q", "b", 0), ("q", "p", 0)], "qid string, docid string, label int")
    assert tuple(training.candidate_lists(groups, 2).first()) == ("q", ["p"], ["p", "a"])
    assert training.split_rows(groups, ["qid", "docid", "label"], 0.25).where("split = 'dev'").count() == 1
    with pytest.raises(ValueError, match="leave a split empty"):
        training.split_by_query(groups, filled=True)


def test_stored_index(spark, docs):
    q = spark.createDataFrame([("q1", "red fox"), ("q2", "blue")], "qid string, query string")
    i = index.stored(docs.unionByName(docs), "docid", fields(), buckets=2)
    terms = index.query_terms(q, "qid", simple_tokens("query"))
    a = {(r.qid, r.docid, round(r.score, 8)) for r in index.bm25_scores(terms, i.posts, i.statistics, frequencies=i.frequencies).collect()}
    b = {(r.qid, r.docid, round(r.score, 8)) for r in index.bm25_scores(terms, index.postings(docs, "docid", fields()), index.field_statistics(docs, fields())).collect()}
    assert a == b and a
    plan = index.ranked(index.bm25_scores(terms, i.posts, i.statistics, frequencies=i.frequencies), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of 2" in plan


def test_boosted_ranker(spark, tmp_path):
    """Learns an order that no single feature has, skips queries of one kind, and its file gives the same scores."""
    from quaero.operators import boosting

    rng = np.random.default_rng(4)
    rows = []
    for q in range(60):
        x = rng.normal(size=(20, 3))
        good = int(np.argmax(x[:, 0] + x[:, 1]))
        rows += [(f"q{q}", f"d{i:02}", i + 1, float(i == good and q != 7), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "qid string, docid string, rank int, label double, a double, b double, c double")
    model = boosting.fit(df.where("qid < 'q5'"), ["a", "b", "c"], trees=12, depth=2)
    out = boosting.scored(df, ["a", "b", "c"], model)
    held = out.where("qid >= 'q5'").toPandas()
    mrr = lambda by: np.mean([1 / (1 + (g[by] > g.loc[g.label == 1, by].iloc[0]).sum()) for _, g in held.groupby("qid") if g.label.max() > 0])
    assert mrr("score") > 0.7 > mrr("a") and mrr("score") > mrr("b") + 0.15
    boosting.write_booster(spark, model, ["a", "b", "c"], str(tmp_path / "m"))
    names, again = boosting.read_booster(spark, str(tmp_path / "m"))
    assert names == ["a", "b", "c"] and again == model
    assert boosting.fit(df.where("qid = 'q7'"), names) == []
    g, h = boosting.gradients(np.array([0.0, 1.0, 0.5]), np.array([1, 0, 0]))
    assert g[0] > 0 and abs(g.sum()) < 1e-12 and (g[1:] < 0).all() and (h > 0).all()


def test_prompted_scorers(spark):
    df = spark.createDataFrame([("q", "yes"), ("q", "no")], "q string, t string")

    def logits(prompts):
        assert all(p.startswith("question:q \n \n passage:") for p in prompts)
        return [2.0 if p.endswith("yes") else -2.0 for p in prompts]

    def full(prompts):
        raise RuntimeError("CUDA out of memory")

    def broken(prompts):
        raise RuntimeError("no such model")

    get = lambda s: [r[0] for r in df.orderBy(F.col("t").desc()).select(s(F.col("q"), F.col("t"))).collect()]
    assert get(rerank.prompted_scorer(logits)) == pytest.approx([1 / (1 + math.exp(-2)), 1 / (1 + math.exp(2))])
    assert get(rerank.prompted_scorer(logits, activation="raw")) == [2.0, -2.0]
    two = lambda ps: [(1.0, 1.0) for _ in ps]
    assert get(rerank.prompted_scorer(two, "instruct", "yes_no")) == [0.5, 0.5]
    assert get(rerank.prompted_scorer(full, fallback=0.0)) == [0.0, 0.0]
    with pytest.raises(Exception, match="no such model"):
        get(rerank.prompted_scorer(broken))
    with pytest.raises(ValueError):
        rerank.prompted_scorer(logits, activation="tanh")


def test_query_set_differences(spark):
    run = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("b", "4"), ("c", "9")], "system string, qid string")
    got = {(r.group1, r.group2): (r.missing, r.extra) for r in fusion.symmetric_differences(run).collect()}
    assert got == {("a", "b"): (1, 2), ("a", "c"): (2, 1), ("b", "c"): (3, 1)}


def test_synonyms_are_compared_in_many_tasks(spark, monkeypatch):
    """The model's vectors come in one partition; they are spread before all words are compared."""
    from pyspark.sql import functions as F

    from quaero.operators import dense, index

    seen, topk = [], dense.dense_topk
    monkeypatch.setattr(dense, "dense_topk", lambda q, d, *a: seen.append(d.rdd.getNumPartitions()) or topk(q, d, *a))
    docs = spark.createDataFrame([(" ".join(f"w{(i * k) % 30}" for k in range(1, 12)),) for i in range(60)], "text string")
    rows = index.synonym_dictionary(docs, F.split("text", " "), size=8, window=3, passes=1, parts=1, threshold=-1.0).collect()
    assert seen[0] > 1 and len(rows) == 30 and all(len({s.term for s in r.synonyms} - {r.term}) == 10 for r in rows)
