"""Runs: normal form, fusion and learned features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions.text import identifier
from quaero.session import written

MISSING = 2147483647


def normal_run(entries: DataFrame, run: str = "run_name", query: str = "qid", item: str = "docid", score: str = "score", rank: str = "rank", position: str | None = None) -> DataFrame:
    """(system, qid, docid, rank, score): one row for each document, best rank and score, renumbered from 1.

    Blank documents go; a rank below 1 or null is replaced by the entry's
    ``position`` where the entries have an order; a table has none, so there it
    comes after all others. NaN counts as no score. Order: rank, score falling with nulls last, docid.
    """
    s = F.when(~F.isnan(score), F.col(score))
    r = F.when(F.col(rank) >= 1, F.col(rank)).otherwise(F.col(position).cast("int") if position else MISSING)
    one = (
        entries.select(F.col(run).alias("system"), F.col(query).alias("qid"), identifier(item).alias("docid"), r.alias("r"), s.alias("s"))
        .where("docid is not null").groupBy("system", "qid", "docid").agg(F.min("r").alias("r"), F.max("s").alias("score"))
    )
    w = Window.partitionBy("system", "qid").orderBy("r", F.col("score").desc_nulls_last(), "docid")
    return one.select("system", "qid", "docid", F.row_number().over(w).alias("rank"), "score")


def reciprocal_rank_fusion(run: DataFrame, c: int = 60) -> DataFrame:
    """(qid, docid, support, rrf, best_rank, mean_rank, place): evidence of all systems; order by support, then RRF, best rank, mean rank, docid."""
    e = run.groupBy("qid", "docid").agg(
        F.count("*").alias("support"), F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("rrf"), F.min("rank").alias("best_rank"), F.round(F.avg("rank"), 9).alias("mean_rank")
    )
    w = Window.partitionBy("qid").orderBy(F.col("support").desc(), F.col("rrf").desc(), "best_rank", "mean_rank", "docid")
    return e.withColumn("place", F.row_number().over(w))


def min_max(score: Column, w: Window) -> Column:
    """Scaled to 0..1 in its window; 0 where the range is not above 1e-12."""
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo > 1e-12, (score - lo) / (hi - lo)).otherwise(0.0)


def rank_features(rank: Column, n: Column) -> dict[str, Column]:
    """Fraction, reciprocal and discount of a rank that begins at 1."""
    return {
        "rank_fraction": F.when(n > 1, 1 - (rank - 1) / (n - 1)).otherwise(1.0),
        "reciprocal_rank": 1.0 / rank,
        "rank_discount": 1.0 / F.log2(rank + 1.0),
    }


def linear_fusion(run: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(qid, docid, score): weighted sum of each system's min-max scores; a missing score adds nothing."""
    w = Window.partitionBy("system", "qid")
    weight = F.lit(None).cast("double")
    for s, x in weights.items():
        weight = F.when(F.col("system") == s, F.lit(float(x))).otherwise(weight)
    scaled = run.where(F.col("system").isin(list(weights))).where("score is not null").withColumn("x", min_max(F.col("score"), w) * weight)
    return scaled.groupBy("qid", "docid").agg(F.round(F.sum("x"), 9).alias("score"))


def fusion_features(run: DataFrame, first: str, others: list[str]) -> DataFrame:
    """A row of features for each candidate of the ``first`` system: raw and min-max scores of all, rank features of the first."""
    w = Window.partitionBy("qid")
    out = run.where(F.col("system") == first).select("qid", "docid", "rank", F.coalesce("score", F.lit(0.0)).alias("s0"))
    for i, o in enumerate(others, 1):
        out = out.join(run.where(F.col("system") == o).select("qid", "docid", F.col("score").alias(f"s{i}")), ["qid", "docid"], "left").fillna(0.0, [f"s{i}"])
    cols = {f"s{i}_minmax": min_max(F.col(f"s{i}"), w) for i in range(len(others) + 1)}
    cols |= rank_features(F.row_number().over(w.orderBy("rank")), F.count("*").over(w))
    return out.withColumns({k: F.round(c, 9) for k, c in cols.items()})


def learned_fusion(features: DataFrame, qrels: DataFrame, **options: float) -> DataFrame:
    """(qid, docid, score, rank): the candidates under a list-wise ranker of boosted trees that is fitted on the queries with gold; without such a query, by the first score.

    ``options`` go to ``boosting.fit``.
    """
    from quaero.operators import boosting

    names = [c for c in features.columns if c not in ("qid", "docid", "rank")]
    data = written(features.join(qrels.select("qid", "docid", F.lit(1.0).alias("label")), ["qid", "docid"], "left").fillna(0.0, ["label"]), "features")
    model = boosting.fit(data, names, **options)
    out = boosting.scored(data, names, model) if model else data.withColumn("score", F.col("s0"))
    v = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("s0").desc(), "docid")
    return out.select("qid", "docid", "score", F.row_number().over(v).alias("rank"))


def coverage(run: DataFrame, queries: DataFrame) -> DataFrame:
    """(system, ranking_qids, matched_qids, coverage) against a query set."""
    q = queries.select("qid").distinct()
    n = q.count()
    s = run.select("system", "qid").distinct()
    m = s.join(q.withColumn("in_set", F.lit(1)), "qid", "left")
    return m.groupBy("system").agg(F.count("*").alias("ranking_qids"), F.count("in_set").alias("matched_qids"), F.round(F.count("in_set") / F.lit(float(max(n, 1))), 6).alias("coverage"))


def query_set_differences(run: DataFrame) -> DataFrame:
    """(system, missing): queries that some system answers and this one does not, for each system."""
    sq = run.select("system", "qid").distinct()
    n = sq.select("qid").distinct().agg(F.count("*").alias("n"))
    return sq.groupBy("system").agg(F.count("*").alias("has")).crossJoin(F.broadcast(n)).select("system", (F.col("n") - F.col("has")).alias("missing"))


def symmetric_differences(run: DataFrame) -> DataFrame:
    """(group1, group2, missing, extra) of each pair of systems: queries of group1 that group2 lacks, and the other way round. From counts of shared queries, not from sets."""
    sq = run.select("system", "qid").distinct()
    n = sq.groupBy("system").agg(F.count("*").alias("n"))
    a, b = sq.select(F.col("system").alias("group1"), "qid"), sq.select(F.col("system").alias("group2"), "qid")
    both = a.join(b, "qid").where("group1 < group2").groupBy("group1", "group2").agg(F.count("*").alias("both"))
    pairs = n.select(F.col("system").alias("group1"), F.col("n").alias("n1")).join(n.select(F.col("system").alias("group2"), F.col("n").alias("n2")), F.expr("group1 < group2"))
    j = pairs.join(both, ["group1", "group2"], "left")
    k = F.coalesce("both", F.lit(0))
    return j.select("group1", "group2", (F.col("n1") - k).alias("missing"), (F.col("n2") - k).alias("extra"))
