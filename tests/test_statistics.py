"""Statistics against brute force and textbook values."""

import math
import random

import numpy as np
import pytest

from quaero.functions import distributions as dist
from quaero.operators import statistics as st


@pytest.fixture(scope="module")
def scores(spark):
    r = random.Random(3)
    rows = [(s, f"q{i}", round(r.choice([0, 0.25, 0.5, 1]) * (1 + 0.1 * k), 3)) for k, s in enumerate("abcd") for i in range(40)]
    return spark.createDataFrame(rows, "system string, qid string, score double")


def matrix(scores):
    rows = {(r.system, r.qid): r.score for r in scores.collect()}
    return np.array([[rows[s, f"q{i}"] for s in "abcd"] for i in range(40)])


def avg_ranks(v):
    return np.array([np.sum(v < x) + (np.sum(v == x) + 1) / 2 for x in v])


def test_anova(scores):
    m = matrix(scores)
    g = m.mean()
    ss, sb = 40 * ((m.mean(0) - g) ** 2).sum(), 4 * ((m.mean(1) - g) ** 2).sum()
    se = ((m - g) ** 2).sum() - ss - sb
    t = {r.source: r for r in st.anova(scores).collect()}
    assert t["system"].sum_sq == pytest.approx(ss, abs=1e-5) and t["residual"].df == 117 and t["system"].f == pytest.approx(ss / 3 / (se / 117), abs=1e-4)
    p = {r.source: r.p for r in st.anova_p_values(st.anova(scores)).collect()}
    assert 0 <= p["system"] <= 1 and p["residual"] is None


def test_friedman(scores):
    m = matrix(scores)
    ranks = np.array([avg_ranks(v) for v in m])
    n, k = m.shape
    ties = sum(c**3 - c for v in m for c in np.unique(v, return_counts=True)[1])
    want = (12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1)))
    assert st.friedman(scores).first().statistic == pytest.approx(want, abs=1e-4)
    two = st.friedman(scores.where("system in ('a', 'b')")).first()
    assert two.statistic is None and two.note
    same = st.friedman(scores.selectExpr("system", "qid", "1.0D as score")).first()
    assert same.statistic == 0 and st.friedman_p_value(st.friedman(scores.selectExpr("system", "qid", "1.0D as score"))).first().p == 1


def test_wilcoxon(scores):
    m = matrix(scores)
    got = {(r.group1, r.group2): r for r in st.wilcoxon(scores).collect()}
    d = np.round(m[:, 1] - m[:, 0], 9)
    r = avg_ranks(np.abs(d))
    w = min(r[d > 0].sum(), r[d < 0].sum())
    n, z = len(d), int((d == 0).sum())
    ties = sum(c**3 - c for c in np.unique(np.abs(d[d != 0]), return_counts=True)[1])
    mu = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24
    assert got["a", "b"].w == w and got["a", "b"].z == pytest.approx((w - mu) / math.sqrt(var), abs=1e-5)
    same = st.wilcoxon(scores.selectExpr("system", "qid", "1.0D as score")).first()
    assert same.w == 0 and st.with_normal_p(st.wilcoxon(scores.selectExpr("system", "qid", "1.0D as score"))).first().p == 1


def test_wilcoxon_binary_from_counts(spark):
    """On a binary metric W and z follow from wins, losses and ties alone."""
    rows = [("a", f"q{i}", 0.0) for i in range(30)] + [("b", f"q{i}", 1.0 if i < 12 else 0.0) for i in range(30)]
    r = st.wilcoxon(spark.createDataFrame(rows, "system string, qid string, score double")).first()
    assert (r.wins, r.losses, r.ties, r.w) == (12, 0, 18, 0.0)
    assert r.z == pytest.approx(-math.sqrt(12), abs=1e-5)


def test_holm(spark):
    df = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03), ("w", 0.9)], "k string, p double")
    got = {r.k: (round(r.p_holm, 6), r.reject) for r in st.holm(df).collect()}
    assert got == {"x": (0.04, True), "z": (0.09, False), "y": (0.09, False), "w": (0.9, False)}


def test_interval_and_distributions(spark):
    assert dist.t_quantile(spark, 0.975, 14976) == pytest.approx(1.96012, abs=1e-5)
    assert dist.studentised_range_quantile(0.95, 3, 20) == pytest.approx(3.578, abs=2e-3)
    assert dist.chi2_tail(spark, 3.841459, 1) == pytest.approx(0.05, abs=1e-6) and dist.normal_tail_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    one = spark.createDataFrame([("a", "q", 0.5)], "system string, qid string, score double")
    r = st.with_t_interval(st.summary(one)).first()
    assert (r.std_dev, r.ci_low, r.ci_high) == (0.0, 0.5, 0.5)


def test_blocks(scores):
    assert st.checked_blocks(scores).first().complete
    r = st.checked_blocks(scores.where("not (system = 'a' and qid = 'q1')")).first()
    assert not r.complete and r.rows == 159


def test_medians_and_quartiles_from_counts(spark):
    r = random.Random(9)
    rows = [(s, f"q{i}", r.choice([0.0, 0.1, 0.5, 1.0])) for s in "abc" for i in range({"a": 7, "b": 8, "c": 1}[s])]
    df = spark.createDataFrame(rows, "system string, qid string, score double")
    for x, y in zip(sorted(st.five_numbers(df).collect()), sorted(st.summary(df).collect())):
        v = np.array([s for k, _, s in rows if k == x.system])
        assert [x.lowest, x.q1, x.median, x.q3, x.highest] == pytest.approx([v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]) and y.median == pytest.approx(np.median(v))


def test_blocks_are_required(spark, scores):
    assert st.required_blocks(scores) is scores
    with pytest.raises(ValueError, match="1 queries that a system lacks, as q1"):
        st.required_blocks(scores.where("not (system = 'a' and qid = 'q1')"))
    with pytest.raises(ValueError, match="40 rows given twice, as a/q0"):
        st.required_blocks(scores.unionByName(scores.where("system = 'a'")))
    with pytest.raises(ValueError, match="without a score"):
        st.required_blocks(scores.selectExpr("system", "qid", "if(qid = 'q3', null, score) as score"))


def test_tukey_report(scores):
    t = {(r.group1, r.group2): r for r in st.tukey_report(scores).collect()}
    old = {(r.group1, r.group2): r for r in st.tukey_p_values(st.tukey(scores), 4, 117).collect()}
    assert len(t) == 6 and len(next(iter(t.values()))) == 14
    for k, r in t.items():
        assert r.q == pytest.approx(old[k].q, abs=1e-4) and r.reject == old[k].reject and r.p == pytest.approx(old[k].p, abs=1e-4)
        assert r.reject == (r.ci_low > 0 or r.ci_high < 0) and r.mean2 - r.mean1 == pytest.approx(r.mean_diff)


def test_least_squares(spark):
    rows = [(float(i), float(i * i % 7), 2 + 3.0 * i - 0.5 * (i * i % 7)) for i in range(50)] + [(None, 1.0, 1.0)]
    got = {r.term: r for r in st.least_squares(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"]).collect()}
    assert [round(got[k].coefficient, 6) for k in ("intercept", "a", "b")] == [2, 3, -0.5] and got["a"].r2 == pytest.approx(1)


def test_by_metric(scores):
    from pyspark.sql import functions as F

    long = scores.withColumn("metric", F.lit("x")).unionByName(scores.withColumn("metric", F.lit("y")))
    assert st.by_metric(long, st.summary, ["x", "y"]).count() == 8


def test_wilcoxon_of_hits(spark, scores):
    """Absent rows are zeros: the same table as from complete blocks, with medians that are not 0, negative scores and a system without hits."""
    full = scores.where("system <> 'd'").selectExpr("system", "qid", "if(system = 'b' and score < 0.3, -score, score) as score").unionByName(scores.where("system = 'd'").selectExpr("'d' as system", "qid", "0.0D as score"))
    key = lambda df: sorted(tuple(r.asDict()[c] for c in st.wilcoxon(scores).columns) for r in df.collect())
    got, want = key(st.wilcoxon_of_hits(full.where("score <> 0"), full.select("system").distinct(), 40)), key(st.wilcoxon(full))
    assert len(got) == 6 and any(r[9] for r in want)
    for x, y in zip(got, want):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-9)
    more = {(r.group1, r.group2): r for r in st.wilcoxon_of_hits(full, full.select("system").distinct(), 3_000_000_000).collect()}
    assert more["a", "b"].n == 3_000_000_000 and more["a", "b"].median_diff == 0 and more["a", "b"].wins == got[0][3]
    assert st.wilcoxon_of_hits(full.limit(0), full.select("system").distinct(), 0).count() == 0


def test_paired_tests_read_hits_only(spark, monkeypatch):
    from quaero.plans import evaluation

    def no_grid(*_):
        raise AssertionError("every run with every query")

    monkeypatch.setattr(evaluation.t, "grid", no_grid)
    assert evaluation.wilcoxon_holm(spark, "/root/testdata/sf0.001").count() == 66


def test_holm_steps_read_hits_only(spark, monkeypatch):
    from quaero.plans import evaluation

    monkeypatch.delattr(evaluation.t, "grid")
    assert evaluation.holm_steps(spark, "/root/testdata/sf0.001").count() == 66


def test_mean_differences_and_diagonal(spark, scores, monkeypatch):
    """The same means as the paired test; a single system still has its diagonal."""
    from quaero.plans import evaluation

    names = scores.select("system").distinct()
    got = {(r.group1, r.group2): r.mean_diff for r in st.mean_differences(scores.where("score <> 0"), names, 40).collect()}
    assert got == {(r.group1, r.group2): pytest.approx(r.mean_diff, abs=2e-9) for r in st.wilcoxon(scores).collect()}
    one = names.where("system = 'a'")
    assert [tuple(r) for r in st.symmetric_matrix(st.mean_differences(scores, one, 40), "mean_diff", one).collect()] == [("a", "a", 1.0)]
    monkeypatch.delattr(evaluation.t, "grid")
    assert evaluation.symmetric_matrix(spark, "/root/testdata/sf0.001").count() == 144


def test_pratt_reads_hits_only(spark, monkeypatch):
    from quaero.plans import evaluation

    monkeypatch.delattr(evaluation.t, "grid")
    assert evaluation.wilcoxon_pratt(spark, "/root/testdata/sf0.001").count() == 66


def test_metrics_tested_reads_hits_only(spark, monkeypatch):
    from quaero.plans import evaluation

    monkeypatch.delattr(evaluation.t, "grid")
    assert evaluation.metrics_tested(spark, "/root/testdata/sf0.001").count() == 132
