"""Retrieval metrics of runs against qrels.

The runs are cut to their relevant rows first (a join with the qrels); all
windows and sums then run on as many rows as there are hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, PRECISION_CUTS, GAIN_CUTS = (1, 5, 10, 100), (1, 5, 10), (5, 10, 100)
METRICS = [*(f"recall_{k}" for k in CUTS), *(f"precision_{k}" for k in PRECISION_CUTS), "f1_1", "mrr_5", "ap", *(f"ndcg_{k}" for k in GAIN_CUTS)]


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def per_query(run: DataFrame, qrels: DataFrame, grid: DataFrame | None, golds: DataFrame | None = None) -> DataFrame:
    """A row of metrics for each (system, qid) of ``grid``; a query that a run lacks counts with zeros and rank -1. Without a grid (None) only the rows with a hit are given; those left out have zeros.

    run: (system, qid, docid, rank); qrels: (qid, docid), distinct. Precision
    is over k, never over the list's length; AP is over the whole list and all
    relevant documents. ``golds`` (qid, golds) gives the number of relevant
    documents where ``qrels`` holds only those that were retrieved.
    """
    golds = qrels.groupBy("qid").agg(F.count("*").alias("golds")) if golds is None else golds
    w = Window.partitionBy("system", "qid").orderBy("rank")
    hits = run.join(qrels.select("qid", "docid"), ["qid", "docid"]).withColumn("so_far", F.row_number().over(w))
    r = F.col("rank")
    sums = [F.min("rank").alias("first_rank"), F.sum(F.col("so_far") / r).alias("ap_sum")]
    sums += [F.sum((r <= k).cast("int")).alias(f"h{k}") for k in sorted({*CUTS, *PRECISION_CUTS})]
    sums += [F.sum(F.when(r <= k, _gain(r)).otherwise(0.0)).alias(f"d{k}") for k in GAIN_CUTS]
    found = hits.groupBy("system", "qid").agg(*sums)
    g = found.join(golds, "qid", "left") if grid is None else grid.join(golds, "qid", "left").join(found, ["system", "qid"], "left")
    n = F.coalesce("golds", F.lit(0))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + _gain(i))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    first = F.coalesce("first_rank", F.lit(-1))
    out = {f"recall_{k}": F.when((first > 0) & (first <= k), 1.0).otherwise(0.0) for k in CUTS}
    out |= {f"precision_{k}": z(F.col(f"h{k}") / F.lit(float(k))) for k in PRECISION_CUTS}
    p, q = out["precision_1"], out["recall_1"]
    out["f1_1"] = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    out["mrr_5"] = F.when((first > 0) & (first <= 5), 1.0 / first).otherwise(0.0)
    out["ap"] = z(F.when(n > 0, F.col("ap_sum") / n))
    out |= {f"ndcg_{k}": z(F.when(n > 0, F.col(f"d{k}") / ideal(k))) for k in GAIN_CUTS}
    return g.select("system", "qid", first.alias("first_rank"), *[F.round(c, 9).alias(k) for k, c in out.items()])


def aggregate(per: DataFrame) -> DataFrame:
    """Means by system; ``f1_1`` is of the averaged precision and recall, ``f1_1_mean`` the mean of each query's."""
    means = [F.round(F.avg(m), 9).alias(m) for m in METRICS if m != "f1_1"]
    p, r = F.avg("precision_1"), F.avg("recall_1")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    spread = [f(m).alias(f"{m}_{n}") for m in ("mrr_5", "ndcg_10") for n, f in (("min", F.min), ("median", F.median), ("max", F.max))]
    return per.groupBy("system").agg(F.count("*").alias("queries"), *means, F.round(f1, 9).alias("f1_1"), F.round(F.avg("f1_1"), 9).alias("f1_1_mean"), *spread)


def long_form(per: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """(metric, system, qid, score)."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return per.select("system", "qid", F.expr(f"stack({len(metrics)}, {pairs}) as (metric, score)")).select("metric", "system", "qid", "score")


def rank_buckets(per: DataFrame) -> DataFrame:
    """(system, bucket, queries, share) of the first relevant rank."""
    r = F.col("first_rank")
    b = F.when(r < 0, "missing").when(r == 1, "1").when(r <= 5, "2-5").when(r <= 10, "6-10").when(r <= 100, "11-100").otherwise(">100")
    w = Window.partitionBy("system")
    return per.groupBy("system", b.alias("bucket")).agg(F.count("*").alias("queries")).withColumn("share", F.round(F.col("queries") / F.sum("queries").over(w), 9))


def by_bucket(per: DataFrame, queries: DataFrame, bucket: Column, metric: str = "mrr_5") -> DataFrame:
    """(system, bucket, queries, mean, ci95) of a metric by a property of the query's text."""
    j = per.join(queries.select("qid", bucket.alias("bucket")), "qid")
    n, sd = F.count("*"), F.coalesce(F.stddev_samp(metric), F.lit(0.0))
    return j.groupBy("system", "bucket").agg(n.alias("queries"), F.round(F.avg(metric), 9).alias("mean"), F.round(1.96 * sd / F.sqrt(n), 9).alias("ci95"))


def graded_ndcg(run: DataFrame, grades: DataFrame, k: int, exponential: bool = True) -> DataFrame:
    """(system, qid, ndcg, ap, p_1, mrr): graded gains with the ideal from the retrieved list; average precision over the relevant rows of the list, whether the first is relevant, and the reciprocal rank of the first relevant one."""
    g = F.coalesce("grade", F.lit(0)).cast("double")
    gain = F.pow(F.lit(2.0), g) - 1 if exponential else g
    j = run.join(grades.select("qid", "docid", "grade"), ["qid", "docid"], "left").withColumn("gain", gain)
    w = Window.partitionBy("system", "qid").orderBy(F.col("gain").desc(), "rank")
    upto = Window.partitionBy("system", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = (F.col("gain") > 0).cast("int")
    j = j.withColumn("best", F.row_number().over(w)).withColumn("hits", F.sum(good).over(upto))
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("gain") * _gain(F.col("rank"))).otherwise(0.0))
    ideal = F.sum(F.when(F.col("best") <= k, F.col("gain") * _gain(F.col("best"))).otherwise(0.0))
    ap = F.coalesce(F.sum(F.when(F.col("gain") > 0, F.col("hits") / F.col("rank"))) / F.sum(good), F.lit(0.0))
    first = F.min(F.when(F.col("gain") > 0, F.col("rank")))
    return j.groupBy("system", "qid").agg(
        F.round(F.when(ideal > 0, dcg / ideal).otherwise(0.0), 9).alias("ndcg"), F.round(ap, 9).alias("ap"),
        F.max(F.when((F.col("rank") == 1) & (F.col("gain") > 0), 1.0).otherwise(0.0)).alias("p_1"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 9).alias("mrr"),
    )


def histogram(values: DataFrame, value: str, width: int) -> DataFrame:
    """(bin, n): counts of bins of a width, named by their lower edge."""
    return values.groupBy((F.floor(F.col(value) / width) * width).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def candidate_mrr(scored: DataFrame, k: int = 10) -> DataFrame:
    """(queries, skipped, mrr) over lists of positives and negatives (qid, docid, label, score): the reciprocal rank of the first positive among the first k by score, ties by docid.

    Queries without a negative or without a positive are skipped and counted.
    """
    has = scored.groupBy("qid").agg(F.max("label").alias("p"), F.min("label").alias("n"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), "docid")
    top = scored.withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("label") > 0)).groupBy("qid").agg(F.min("r").alias("r"))
    both = (F.col("p") > 0) & (F.col("n") <= 0)
    j = has.withColumn("both", both).join(top, "qid", "left")
    used = F.sum(F.col("both").cast("int"))
    return j.agg(F.coalesce(used, F.lit(0)).alias("queries"), F.sum((~F.col("both")).cast("int")).alias("skipped"), F.round(F.coalesce(F.sum(F.when(F.col("both"), F.coalesce(1.0 / F.col("r"), F.lit(0.0)))) / used, F.lit(0.0)), 9).alias("mrr"))


#: Other names under which metrics are asked for.
ALIASES = {"map": "ap", "mrr": "mrr_5", "ndcg": "ndcg_10", "f1": "f1_1", "p_1": "precision_1"}


def metric_name(name: str) -> str:
    """The column of a metric, from its name with any of @, - or _ before the cut-off, or an alias; an unknown one is an error."""
    n = name.lower().replace("@", "_").replace("-", "_")
    n = ALIASES.get(n, n)
    if n not in METRICS:
        raise ValueError(f"no metric {name}; there are {', '.join(METRICS)}")
    return n


def metric_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, first, second, delta) of two metric sets (metric, value), by name; a metric that one lacks has null."""
    j = a.select("metric", F.col("value").alias("first")).join(b.select("metric", F.col("value").alias("second")), "metric", "full")
    return j.withColumn("delta", F.round(F.col("second") - F.col("first"), 9))


def micro_average(per: DataFrame, languages: DataFrame, metrics: list[str]) -> DataFrame:
    """(system, language, queries, metrics...) for each language, and for all queries together as language ``all``: every query weighs the same."""
    j = per.join(languages.select("qid", "language"), "qid")
    cols = [F.count("*").alias("queries"), *[F.round(F.avg(m), 9).alias(m) for m in metrics]]
    return j.groupBy("system", "language").agg(*cols).unionByName(j.groupBy("system").agg(*cols).withColumn("language", F.lit("all")))


def synthetic_scores(run: DataFrame, top: int) -> DataFrame:
    """A run without scores with top - rank + 1 as its score, so that tools that sort by score keep its order."""
    return run.withColumn("score", (F.lit(top + 1) - F.col("rank")).cast("double"))


def length_summary(values: DataFrame, value: str, width: int) -> DataFrame:
    """(bin, n, total, median): the histogram, with the number of values and their median cut to an integer, from counts of distinct values."""
    c = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("c"))
    w = Window.orderBy("v")
    u = c.withColumn("u", F.sum("c").over(w)).withColumn("t", F.sum("c").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("u") >= k, F.col("v")))
    m = u.agg(F.max("t").alias("total"), F.floor((at(F.floor((F.col("t") + 1) / 2)) + at(F.floor((F.col("t") + 2) / 2))) / 2).alias("median"))
    return histogram(values.where(F.col(value).isNotNull()), value, width).crossJoin(F.broadcast(m))
