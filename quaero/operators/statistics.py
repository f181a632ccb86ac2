"""Comparison of systems over the same queries.

Input is (system, qid, score), one row each; ``checked_blocks`` says whether
every system has the same queries. Sums and ranks are plans; the few p-values
of the final rows come from distribution functions on the driver.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaero.functions import distributions as dist
from quaero.session import written


def summary(scores: DataFrame) -> DataFrame:
    """(system, queries, mean, median, std_dev, min, max); the deviation of one value is 0."""
    s = F.col("score")
    middle = _median(counted(scores), ["system"], "score", "c")
    return scores.groupBy("system").agg(
        F.count("*").alias("queries"), F.round(F.avg(s), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(s), F.lit(0.0)), 9).alias("std_dev"), F.min(s).alias("min"), F.max(s).alias("max")
    ).join(middle, "system").select("system", "queries", "mean", "median", "std_dev", "min", "max")


def with_t_interval(stats: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds the Student-t interval of the mean; one value has the mean itself."""
    spark = stats.sparkSession
    ns = [r.queries for r in stats.select("queries").distinct().collect()]
    t = F.lit(0.0)
    for n in ns:
        if n > 1:
            t = F.when(F.col("queries") == n, F.lit(dist.t_quantile(spark, 1 - alpha / 2, n - 1))).otherwise(t)
    half = t * F.col("std_dev") / F.sqrt("queries")
    return stats.withColumn("ci_low", F.round(F.col("mean") - half, 9)).withColumn("ci_high", F.round(F.col("mean") + half, 9))


def required_blocks(scores: DataFrame, most: int = 5) -> DataFrame:
    """The scores, if every system has one row for the same queries and no score is null; else ValueError with counts and samples of what is wrong."""
    twice = scores.groupBy("system", "qid").agg(F.count("*").alias("n")).where("n > 1")
    n = scores.select("system").distinct().count()
    short = scores.groupBy("qid").agg(F.countDistinct("system").alias("n")).where(F.col("n") < n)
    issues = []
    for name, bad, shown in (("rows given twice", twice, ["system", "qid"]), ("queries that a system lacks", short, ["qid"]), ("rows without a score", scores.where("score is null or isnan(score)"), ["system", "qid"])):
        some = bad.select(*shown).orderBy(*shown).limit(most).collect()
        if some:
            issues.append(f"{bad.count()} {name}, as {', '.join('/'.join(map(str, r)) for r in some)}")
    if issues:
        raise ValueError("; ".join(issues))
    return scores


def checked_blocks(scores: DataFrame) -> DataFrame:
    """(systems, queries, rows, duplicates, complete): one row."""
    per = scores.groupBy("system", "qid").agg(F.count("*").alias("n"))
    one = per.agg(F.countDistinct("system").alias("systems"), F.countDistinct("qid").alias("queries"), F.sum("n").alias("rows"), F.sum((F.col("n") > 1).cast("int")).alias("duplicates"))
    return one.withColumn("complete", (F.col("rows") == F.col("systems") * F.col("queries")) & (F.col("duplicates") == 0))


def anova(scores: DataFrame) -> DataFrame:
    """(source, sum_sq, df, f): two-way additive analysis of complete blocks, factors system and query."""
    g = scores.agg(F.avg("score").alias("g"), F.sum(F.col("score") * F.col("score")).alias("sq"), F.count("*").alias("n"))
    sys_ = scores.groupBy("system").agg(F.avg("score").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("s"), F.count("*").alias("k"))
    blk = scores.groupBy("qid").agg(F.avg("score").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("q"), F.count("*").alias("b"))
    x = g.crossJoin(sys_).crossJoin(blk)
    ss_sys = F.col("b") * (F.col("s") - F.col("k") * F.col("g") * F.col("g"))
    ss_blk = F.col("k") * (F.col("q") - F.col("b") * F.col("g") * F.col("g"))
    ss_tot = F.col("sq") - F.col("n") * F.col("g") * F.col("g")
    x = x.select(ss_sys.alias("a"), ss_blk.alias("c"), (ss_tot - ss_sys - ss_blk).alias("e"), (F.col("k") - 1).alias("da"), (F.col("b") - 1).alias("dc"))
    de = F.col("da") * F.col("dc")
    mse = F.col("e") / de
    rows = F.array(
        F.struct(F.lit("system").alias("source"), F.col("a").alias("sum_sq"), F.col("da").alias("df"), (F.col("a") / F.col("da") / mse).alias("f")),
        F.struct(F.lit("query").alias("source"), F.col("c").alias("sum_sq"), F.col("dc").alias("df"), (F.col("c") / F.col("dc") / mse).alias("f")),
        F.struct(F.lit("residual").alias("source"), F.col("e").alias("sum_sq"), de.alias("df"), F.lit(None).cast("double").alias("f")),
    )
    return x.select(F.explode(rows).alias("r")).select("r.source", F.round("r.sum_sq", 6).alias("sum_sq"), F.col("r.df").cast("bigint").alias("df"), F.round("r.f", 6).alias("f"))


def anova_p_values(table: DataFrame) -> DataFrame:
    """Adds the p-value of each F."""
    spark = table.sparkSession
    rows = table.collect()
    de = next(r.df for r in rows if r.source == "residual")
    return spark.createDataFrame([(r.source, r.sum_sq, r.df, r.f, None if r.f is None else dist.f_tail(spark, r.f, r.df, de)) for r in rows], "source string, sum_sq double, df bigint, f double, p double")


def _system_pairs(scores: DataFrame) -> DataFrame:
    a = scores.select("qid", F.col("system").alias("group1"), F.col("score").alias("x"))
    b = scores.select("qid", F.col("system").alias("group2"), F.col("score").alias("y"))
    return a.join(b, "qid").where("group1 < group2").select("qid", "group1", "group2", F.round(F.col("y") - F.col("x"), 9).alias("d"))


def difference_counts(scores: DataFrame) -> DataFrame:
    """(group1, group2, d, c): how many queries of a pair of systems have each difference; map-side partial sums, so that what follows sees distinct differences only."""
    return _system_pairs(scores).groupBy("group1", "group2", "d").agg(F.count("*").alias("c"))


def tukey(scores: DataFrame) -> DataFrame:
    """(group1, group2, mean_diff, q): differences of means in units of the standard error of complete blocks."""
    means = scores.groupBy("system").agg(F.avg("score").alias("m"), F.count("*").alias("b"))
    e = anova(scores).where("source = 'residual'").select((F.col("sum_sq") / F.col("df")).alias("mse"))
    p = means.select(F.col("system").alias("group1"), F.col("m").alias("m1"), "b").join(means.select(F.col("system").alias("group2"), F.col("m").alias("m2")), F.expr("group1 < group2"))
    d = F.col("m2") - F.col("m1")
    return p.crossJoin(F.broadcast(e)).select("group1", "group2", F.round(d, 9).alias("mean_diff"), F.round(F.abs(d) / F.sqrt(F.col("mse") / F.col("b")), 5).alias("q"))


def tukey_p_values(table: DataFrame, k: int, df: float, alpha: float = 0.05) -> DataFrame:
    """Adds p and reject; the table has one row for each pair of systems."""
    spark = table.sparkSession
    crit = dist.studentised_range_quantile(1 - alpha, k, df)
    rows = [(r.group1, r.group2, r.mean_diff, r.q, dist.studentised_range_tail(r.q, k, df), r.q > crit) for r in table.collect()]
    return spark.createDataFrame(rows, "group1 string, group2 string, mean_diff double, q double, p double, reject boolean")


def tukey_report(scores: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The full table of a blocked design: (group1, group2, mean1, mean2, mean_diff, se, q, q_critical, ci_low, ci_high, p, reject, queries, alpha); one row for each pair of systems.

    Blocks that are not complete are refused.
    """
    required_blocks(scores)
    spark = scores.sparkSession
    # One row a system and three of the analysis: small by the number of systems.
    means = {r.system: (r.m, r.b) for r in scores.groupBy("system").agg(F.avg("score").alias("m"), F.count("*").alias("b")).collect()}
    e = anova(scores).where("source = 'residual'").first()
    k, b = len(means), min((x[1] for x in means.values()), default=0)
    schema = "group1 string, group2 string, mean1 double, mean2 double, mean_diff double, se double, q double, q_critical double, ci_low double, ci_high double, p double, reject boolean, queries bigint, alpha double"
    if k < 2 or not e or not e.df:
        return spark.createDataFrame([], schema)
    se, crit, rows = math.sqrt(max(e.sum_sq, 0.0) / e.df / b), dist.studentised_range_quantile(1 - alpha, k, e.df), []
    for x in sorted(means):
        for y in sorted(means):
            if x < y:
                d = means[y][0] - means[x][0]
                q = abs(d) / se if se > 0 else (math.inf if d else 0.0)
                rows.append((x, y, means[x][0], means[y][0], d, se, q, crit, d - crit * se, d + crit * se, dist.studentised_range_tail(q, k, e.df), q > crit, b, alpha))
    return spark.createDataFrame(rows, schema)


def friedman(scores: DataFrame) -> DataFrame:
    """(systems, queries, statistic, note): tie-corrected; fewer than three systems give no statistic, all equal give 0."""
    by = Window.partitionBy("qid")
    r = F.rank().over(by.orderBy("score")) + (F.count("*").over(Window.partitionBy("qid", "score")) - 1) / 2.0
    ranked = scores.withColumn("r", r)
    sums = ranked.groupBy("system").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("k"))
    ties = scores.groupBy("qid", "score").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tt"), F.countDistinct("qid").alias("n"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    c = 1 - F.col("tt") / (n * k * (k * k - 1))
    chi = (12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)) / c
    few = F.col("k") < 3
    return sums.crossJoin(ties).select(
        F.col("k").alias("systems"), F.col("n").alias("queries"),
        F.when(few, F.lit(None).cast("double")).when(c <= 1e-12, 0.0).otherwise(F.round(chi, 6)).alias("statistic"),
        F.when(few, "fewer than three systems").otherwise("").alias("note"),
    )


def friedman_p_value(table: DataFrame) -> DataFrame:
    spark = table.sparkSession
    rows = [(r.systems, r.queries, r.statistic, None if r.statistic is None else (1.0 if r.statistic == 0 else dist.chi2_tail(spark, r.statistic, r.systems - 1)), r.note) for r in table.collect()]
    return spark.createDataFrame(rows, "systems bigint, queries bigint, statistic double, p double, note string")


def wilcoxon(scores: DataFrame) -> DataFrame:
    """(group1, group2, n, wins, losses, ties, mean_diff, ci_low, ci_high, median_diff, w, z) of every pair: signed ranks with zeros ranked (Pratt), two-sided, no continuity correction.

    wins: queries where group2 is better. All differences zero: w = 0, z = 0.
    The interval is the normal one of the mean difference. The windows run over
    the counts of distinct differences, written once, not over queries.
    """
    counts = written(difference_counts(scores), "differences")
    pair = ["group1", "group2"]
    a = counts.groupBy(*pair, F.abs("d").alias("a")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("d") > 0, F.col("c")).otherwise(0)).alias("u"), F.sum(F.when(F.col("d") < 0, F.col("c")).otherwise(0)).alias("v"))
    below = F.sum("t").over(Window.partitionBy(*pair).orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    ranked = a.withColumn("r", below + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    g = ranked.groupBy(*pair).agg(
        F.sum("t").alias("n"), F.sum("u").alias("wins"), F.sum("v").alias("losses"), F.sum(F.when(F.col("a") == 0, F.col("t")).otherwise(0)).alias("ties"),
        F.sum(F.col("u") * F.col("r")).alias("up"), F.sum(F.col("v") * F.col("r")).alias("down"), F.sum(F.when(F.col("a") > 0, t * t * t - t).otherwise(0.0)).alias("tt"),
    )
    c, x = F.col("c"), F.col("d")
    moments = counts.groupBy(*pair).agg(F.sum(c * x).alias("s1"), F.sum(c * x * x).alias("s2"))
    g = g.join(moments, pair).join(_median(counts, pair, "d", "c"), pair)
    return _tested(g)


def _tested(g: DataFrame) -> DataFrame:
    """The columns of ``wilcoxon`` from a pair's counts, rank sums (up, down), tie sum (tt), moments (s1, s2) and median."""
    n, z = F.col("n").cast("double"), F.col("ties").cast("double")
    mean = F.col("s1") / n
    half = F.when(n > 1, 1.96 * F.sqrt(F.greatest((F.col("s2") - n * mean * mean) / (n - 1), F.lit(0.0))) / F.sqrt(n)).otherwise(0.0)
    mu = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - 0.5 * F.col("tt")) / 24
    w = F.least("up", "down")
    return g.select(
        "group1", "group2", "n", "wins", "losses", "ties", F.round(mean, 9).alias("mean_diff"), F.round(mean - half, 9).alias("ci_low"), F.round(mean + half, 9).alias("ci_high"),
        F.col("median").alias("median_diff"), w.alias("w"), F.round(F.when(var > 0, (w - mu) / F.sqrt(var)).otherwise(0.0), 6).alias("z"),
    )


#: Rows of a task, about, of the pairs' distinct differences.
IN_TASK = 1_000_000


def wilcoxon_of_hits(hits: DataFrame, systems: DataFrame, queries: int) -> DataFrame:
    """``wilcoxon`` of every system over the same ``queries`` queries, where ``hits`` (system, qid, score) may lack rows: what is absent has score 0.

    Pairs of systems meet only in queries where both have a score that is not
    0. Each system's counts of distinct scores give the differences of a pair
    as if no such query existed; the queries where both have one are then
    moved to their true difference. What is left are zeros.
    """
    names = systems.select("system", F.row_number().over(Window.orderBy("system")).alias("i"))
    one = written(hits.where("score <> 0").join(F.broadcast(names), "system").select("qid", "i", F.round("score", 9).alias("s")), "scores")
    counts = written(one.groupBy("i", "s").agg(F.count("*").alias("c")), "counts")
    x, y = one.select("qid", "i", F.col("s").alias("x")), one.select("qid", F.col("i").alias("j"), F.col("s").alias("y"))
    moves = F.explode(F.array(*[F.struct(d.alias("d"), F.lit(c).cast("bigint").alias("c")) for d, c in ((-F.col("x"), -1), (F.col("y"), -1), (F.round(F.col("y") - F.col("x"), 9), 1))]))
    both = x.join(y, "qid").where("i < j").select("i", "j", moves.alias("m")).groupBy("i", "j", "m.d").agg(F.sum("m.c").alias("c")).where("c <> 0 and d <> 0")
    n = systems.count()
    others = names.select(F.col("i").alias("j"))
    alone = counts.crossJoin(F.broadcast(others)).where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") < F.col("j"), -F.col("s")).otherwise(F.col("s")).alias("d"), "c")
    tasks = max(hits.sparkSession.sparkContext.defaultParallelism, n * counts.count() // IN_TASK)
    # The number of tasks is set: what follows has a pair's rows in one place, and few bytes for each row.
    d = alone.unionByName(both).repartition(tasks, "i", "j")
    a = d.groupBy("i", "j", F.abs("d").alias("a")).agg(F.sum(F.when(F.col("d") > 0, F.col("c")).otherwise(0)).alias("u"), F.sum(F.when(F.col("d") < 0, F.col("c")).otherwise(0)).alias("v"))
    u, v, t = F.col("u"), F.col("v"), (F.col("u") + F.col("v")).cast("double")
    of = Window.partitionBy("i", "j")
    upto = of.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a = a.withColumns({"below": F.sum(u + v).over(upto) - (u + v), "u_": F.sum("u").over(upto), "v_": F.sum("v").over(upto), "wins": F.sum("u").over(of), "losses": F.sum("v").over(of)})
    r = F.col("below") + (t + 1) / 2
    # The k-th difference from below: the losses stand first, the largest of them in front, then the zeros, then the wins.
    lost = lambda k: F.max(F.when((v > 0) & (F.col("losses") - F.col("v_") + v >= k), F.col("a")))
    won = lambda k: F.min(F.when((u > 0) & (F.lit(queries) - F.col("wins") < k) & (F.col("u_") + queries - F.col("wins") >= k), F.col("a")))
    kth = lambda k: F.coalesce(-lost(k), won(k), F.lit(0.0))
    g = a.groupBy("i", "j").agg(
        F.sum("u").alias("wins"), F.sum("v").alias("losses"), F.sum(u * r).alias("up"), F.sum(v * r).alias("down"), F.sum(t * t * t - t).alias("tt"),
        F.sum((u - v) * F.col("a")).alias("s1"), F.sum(t * F.col("a") * F.col("a")).alias("s2"), ((kth((queries + 1) // 2) + kth((queries + 2) // 2)) / 2).alias("median"),
    )
    first, second = names.select(F.col("system").alias("group1"), "i"), names.select(F.col("system").alias("group2"), F.col("i").alias("j"))
    pairs = first.crossJoin(F.broadcast(second)).where((F.col("i") < F.col("j")) & F.lit(queries > 0))
    g = pairs.join(g, ["i", "j"], "left").fillna(0).withColumn("n", F.lit(queries).cast("bigint")).withColumn("ties", F.col("n") - F.col("wins") - F.col("losses"))
    # Zeros have the first ranks.
    return _tested(g.withColumns({"up": F.col("up") + F.col("wins") * F.col("ties"), "down": F.col("down") + F.col("losses") * F.col("ties")}))


def _median(counts: DataFrame, by: list[str], value: str, count: str) -> DataFrame:
    """(by, median) from counts of distinct values: the mean of the two middle ones where their number is even."""
    w = Window.partitionBy(*by)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_u", upto).withColumn("_n", F.sum(count).over(w))
    at = lambda k: F.min(F.when(F.col("_u") >= k, F.col(value)))
    return c.groupBy(*by).agg(((at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor((F.col("_n") + 2) / 2))) / 2).alias("median"))


def with_normal_p(table: DataFrame, z: str = "z") -> DataFrame:
    """Adds the two-sided normal p-value of a table of system pairs; z = 0 gives 1."""

    @F.pandas_udf("double")
    def p(s: pd.Series) -> pd.Series:
        return s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    return table.withColumn("p", p(F.col(z)))


def holm(table: DataFrame, p: str = "p", alpha: float = 0.05, family: list[str] | None = None) -> DataFrame:
    """Adds p_holm and reject: p rising, times what is left, running maximum, at most 1; within each family."""
    by = Window.partitionBy(*(family or [F.lit(0)]))
    order = by.orderBy(p)
    m = F.count("*").over(by)
    step = F.least(F.col(p) * (m - F.row_number().over(order) + 1), F.lit(1.0))
    t = table.withColumn("_step", step)
    return t.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step").withColumn("reject", F.col("p_holm") < alpha)


def baseline_delta(scores: DataFrame, baseline: str) -> DataFrame:
    """(system, queries, mean_delta, ci95, wins, losses) against one system, paired by query."""
    b = scores.where(F.col("system") == baseline).select("qid", F.col("score").alias("b"))
    d = scores.where(F.col("system") != baseline).join(b, "qid").withColumn("d", F.round(F.col("score") - F.col("b"), 9))
    n = F.count("*")
    return d.groupBy("system").agg(
        n.alias("queries"), F.round(F.avg("d"), 9).alias("mean_delta"), F.round(1.96 * F.coalesce(F.stddev_samp("d"), F.lit(0.0)) / F.sqrt(n), 9).alias("ci95"),
        F.sum((F.col("d") > 0).cast("int")).alias("wins"), F.sum((F.col("d") < 0).cast("int")).alias("losses"),
    )


def metric_matrix(long: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each system, a column of means for each metric."""
    return long.groupBy("system").agg(*[F.round(F.avg(F.when(F.col("metric") == m, F.col("score"))), 9).alias(m) for m in metrics])


def mean_differences(hits: DataFrame, systems: DataFrame, queries: int) -> DataFrame:
    """(group1, group2, mean_diff) of every pair, as in ``wilcoxon_of_hits``: over the same queries the mean of the differences is the difference of the means."""
    sums = systems.join(hits.groupBy("system").agg(F.sum("score").alias("s")), "system", "left").fillna(0.0, ["s"])
    sums = written(sums, "sums")
    first, second = sums.select(F.col("system").alias("group1"), F.col("s").alias("x")), sums.select(F.col("system").alias("group2"), F.col("s").alias("y"))
    pairs = first.crossJoin(F.broadcast(second)).where((F.col("group1") < F.col("group2")) & F.lit(queries > 0))
    return pairs.select("group1", "group2", F.round((F.col("y") - F.col("x")) / F.lit(float(queries)), 9).alias("mean_diff"))


def symmetric_matrix(pairs: DataFrame, value: str, names: DataFrame | None = None) -> DataFrame:
    """(row, col, value): both directions and a diagonal of 1. The diagonal is of the systems in ``names`` (system), else of those in the pairs."""
    if names is not None:
        ways = F.array(F.struct(F.col("group1").alias("row"), F.col("group2").alias("col")), F.struct(F.col("group2").alias("row"), F.col("group1").alias("col")))
        return pairs.select(F.explode(ways).alias("p"), value).select("p.row", "p.col", value).unionByName(names.select(F.col("system").alias("row"), F.col("system").alias("col"), F.lit(1.0).alias(value)))
    both = pairs.select(F.col("group1").alias("row"), F.col("group2").alias("col"), value).unionByName(pairs.select(F.col("group2").alias("row"), F.col("group1").alias("col"), value))
    return both.unionByName(both.select("row", F.col("row").alias("col"), F.lit(1.0).alias(value)).distinct())


def five_numbers(scores: DataFrame) -> DataFrame:
    """(system, lowest, q1, median, q3, highest): the data behind a box plot; quartiles between two values are interpolated. From counts of distinct scores."""
    w = Window.partitionBy("system")
    c = counted(scores).withColumn("_n", F.sum("c").over(w)).withColumn("_u", F.sum("c").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def at(p: float) -> Column:
        h = (F.col("_n") - 1) * p
        value = lambda k: F.min(F.when(F.col("_u") >= k + 1, F.col("score")))
        part = F.max(h - F.floor(h))
        return F.round(value(F.floor(h)) * (1 - part) + value(F.ceil(h)) * part, 9)

    return c.groupBy("system").agg(F.min("score").alias("lowest"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("score").alias("highest"))


def correlations(table: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """One row: the Pearson correlation of y with each x."""
    return table.agg(*[F.round(F.corr(y, x), 6).alias(x) for x in xs])


def residuals(scores: DataFrame) -> DataFrame:
    """(system, qid, residual) of the additive block design. The system means are one row a system and joined, not computed over a system's rows in one task."""
    by = lambda k, name: scores.groupBy(k).agg(F.avg("score").alias(name))
    g = scores.agg(F.avg("score").alias("g"))
    j = scores.join(by("system", "ms"), "system").join(by("qid", "mq"), "qid").crossJoin(F.broadcast(g))
    return j.select("system", "qid", F.round(F.col("score") - F.col("ms") - F.col("mq") + F.col("g"), 9).alias("residual"))


def counted(scores: DataFrame) -> DataFrame:
    """(system, score, c): counts of the distinct scores of a system."""
    return scores.groupBy("system", "score").agg(F.count("*").alias("c"))


def least_squares(table: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient, r2): ordinary least squares of y on the columns and an intercept.

    The cluster sums products in one pass; the normal equations of the few columns are solved on the driver.
    """
    import numpy as np

    names = ["", *xs]
    col = lambda n: F.lit(1.0) if not n else F.col(n).cast("double")
    full = table.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    r = full.agg(*[F.sum(col(names[i]) * col(names[j])).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(col(n) * col(y)).alias(f"q{i}") for i, n in enumerate(names)], F.sum(col(y) * col(y)).alias("yy")).first()
    if not r["p0_0"]:
        raise ValueError("no complete row")
    a = np.zeros((len(names), len(names)))
    for i, j in pairs:
        a[i, j] = a[j, i] = r[f"p{i}_{j}"]
    b = np.array([r[f"q{i}"] for i in range(len(names))])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    total = r["yy"] - b[0] * b[0] / a[0, 0]
    error = r["yy"] - 2 * beta @ b + beta @ a @ beta
    r2 = float(1 - error / total) if total > 1e-12 else 0.0
    return table.sparkSession.createDataFrame([(n or "intercept", round(float(v), 9), round(r2, 9)) for n, v in zip(names, beta)], "term string, coefficient double, r2 double")


def by_metric(long: DataFrame, test, metrics: list[str]) -> DataFrame:
    """The rows of ``test``, a function of (system, qid, score), for each metric of a long table, with the metric's name in front."""
    parts = [test(long.where(F.col("metric") == m).select("system", "qid", "score")) for m in metrics]
    return reduce(DataFrame.unionByName, [p.select(F.lit(m).alias("metric"), *p.columns) for m, p in zip(metrics, parts)])
