"""Queries of metrics and statistics over the loaded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.functions.text import entity_cues, token_count
from quaero.operators import metrics as m
from quaero.operators import statistics as st
from quaero.plans import tables as t
from quaero.plans.retrieval import DENSE, _dense_ranked
from quaero.plans.texts import cues_sql
from quaero.session import table, written

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _per(spark, d) -> DataFrame:
    return m.per_query(t.runs(spark, d), t.golds(spark, d), t.grid(spark, d))


def _hits(spark, d) -> DataFrame:
    """The rows of ``_per`` that have a hit; the metrics of all others are 0."""
    return m.per_query(t.runs(spark, d), t.golds(spark, d), None)


def _tested(spark, d, scores: DataFrame) -> DataFrame:
    """The paired test of every two runs over the judged queries, from the scores of hits."""
    return st.wilcoxon_of_hits(scores, written(t.systems(spark, d), "systems"), t.judged(spark, d).count())


def _hit_scores(spark, d, metric="ndcg_10") -> DataFrame:
    return _hits(spark, d).select("system", "qid", F.col(metric).alias("score"))


def _long(df: DataFrame, *ints: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ints})


DBL = "CAST({} AS DOUBLE)"


def _per_sql(grid: str, golds: str, runs: str) -> str:
    sums = ", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in (1, 5, 10)) + ", " + ", ".join(f"sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}" for k in m.GAIN_CUTS)
    cols = [f"round(CASE WHEN fr > 0 AND fr <= {k} THEN CAST(1 AS DOUBLE) ELSE 0 END, 9) AS recall_{k}" for k in m.CUTS]
    cols += [f"round(coalesce(h{k} / CAST({k} AS DOUBLE), 0), 9) AS precision_{k}" for k in m.PRECISION_CUTS]
    cols += ["round(CASE WHEN coalesce(h1, 0) > 0 THEN 2 * coalesce(h1, 0) * CAST(1 AS DOUBLE) / (coalesce(h1, 0) + 1) ELSE 0 END, 9) AS f1_1", "round(CASE WHEN fr > 0 AND fr <= 5 THEN CAST(1 AS DOUBLE) / fr ELSE 0 END, 9) AS mrr_5", "round(coalesce(ap / n, 0), 9) AS ap"]
    cols += [f"round(coalesce(d{k} / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg_{k}" for k in m.GAIN_CUTS]
    return f"""gc AS (SELECT qid, count(*) AS n FROM {golds} GROUP BY qid),
ht AS (SELECT r.system, r.qid, r.rank, row_number() OVER (PARTITION BY r.system, r.qid ORDER BY r.rank) AS k FROM {runs} r JOIN {golds} USING (qid, docid)),
hs AS (SELECT system, qid, min(rank) AS fr, sum(k / CAST(rank AS DOUBLE)) AS ap, {sums} FROM ht GROUP BY system, qid),
gg AS (SELECT g.system, g.qid, coalesce(fr, -1) AS fr, n, ap, h1, h5, h10, d5, d10, d100 FROM {grid} g LEFT JOIN gc USING (qid) LEFT JOIN hs ON hs.system = g.system AND hs.qid = g.qid),
per AS (SELECT system, qid, fr AS first_rank, {', '.join(cols)} FROM gg)"""


PER = f"WITH {t.RUNS}, {t.GOLDS}, {t.JUDGED}, {t.GRID}, " + _per_sql("grid", "golds", "runs")
SIX = ", ".join(f"round({x}, 6) AS {x}" for x in m.METRICS)


@query(PER + f" SELECT system, qid, CAST(first_rank AS BIGINT) AS first_rank, {SIX} FROM per")
def metrics_per_query(spark, d):
    return _per(spark, d).select("system", "qid", F.col("first_rank").cast("bigint").alias("first_rank"), *[F.round(x, 6).alias(x) for x in m.METRICS])


AGG = ", ".join(f"round(avg({x}), 6) AS {x}" for x in m.METRICS if x != "f1_1")


@query(PER + f""" SELECT system, count(*) AS queries, {AGG}, round(CASE WHEN avg(precision_1) + avg(recall_1) > 0 THEN 2 * avg(precision_1) * avg(recall_1) / (avg(precision_1) + avg(recall_1)) ELSE 0 END, 6) AS f1_1, round(avg(f1_1), 6) AS f1_1_mean,
round(min(mrr_5), 6) AS mrr_5_min, round(median(mrr_5), 6) AS mrr_5_median, round(max(mrr_5), 6) AS mrr_5_max, round(min(ndcg_10), 6) AS ndcg_10_min, round(median(ndcg_10), 6) AS ndcg_10_median, round(max(ndcg_10), 6) AS ndcg_10_max FROM per GROUP BY system""")
def metrics_aggregate(spark, d):
    a = m.aggregate(_per(spark, d))
    return a.select("system", "queries", *[F.round(c, 6).alias(c) for c in a.columns if c not in ("system", "queries")])


MULTI = DENSE + """, golds AS (SELECT a.vec_id AS qid, b.vec_id AS docid FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), runs AS (SELECT 'dense' AS system, qid, docid, rank FROM de), grid AS (SELECT DISTINCT 'dense' AS system, vec_id AS qid FROM embeddings), """ + _per_sql("grid", "golds", "runs")


def _labels(spark, d, run: DataFrame) -> DataFrame:
    """(qid, docid) of the retrieved rows whose vectors have the same label; pairs of a whole label are never made."""
    e = table(spark, d, "embeddings").select("vec_id", "label").distinct()
    q, b = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("lq")), e.select(F.col("vec_id").alias("docid"), F.col("label").alias("ld"))
    return run.select("qid", "docid").join(q, "qid").join(b, "docid").where("lq = ld").select("qid", "docid")


def _same_label(spark, d) -> DataFrame:
    """(qid, golds): how many other vectors have a vector's label, from counts."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label").distinct()
    return e.join(e.groupBy("label").agg((F.count("*") - 1).alias("golds")), "label").where("golds > 0").select("qid", "golds")


@query(MULTI + f" SELECT system, qid, CAST(first_rank AS BIGINT) AS first_rank, {SIX} FROM per")
def metrics_multi_gold(spark, d):
    """Several relevant documents: those of the query vector's label."""
    run = _dense_ranked(spark, d).withColumn("system", F.lit("dense"))
    grid = table(spark, d, "embeddings").select(F.lit("dense").alias("system"), F.col("vec_id").alias("qid")).distinct()
    run = written(run, "run")
    return m.per_query(run, _labels(spark, d, run), grid, golds=_same_label(spark, d)).select("system", "qid", F.col("first_rank").cast("bigint").alias("first_rank"), *[F.round(x, 6).alias(x) for x in m.METRICS])


@query(DENSE + """, g AS (SELECT de.*, CASE WHEN a.label = b.label THEN CASE WHEN de.docid % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS grade FROM de JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = docid),
x AS (SELECT *, pow(2, grade) - 1 AS gain, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, rank) AS best FROM g)
SELECT 'dense' AS system, qid, round(round(coalesce(sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN gain / log2(best + 1) ELSE 0 END), 0), 0), 9), 6) AS ndcg FROM x GROUP BY qid""")
def ndcg_graded(spark, d):
    run = _dense_ranked(spark, d).withColumn("system", F.lit("dense"))
    run = written(run, "run")
    g = _labels(spark, d, run).withColumn("grade", F.when(F.col("docid") % 2 == 0, 2).otherwise(1))
    return m.graded_ndcg(run, g, 10).select("system", "qid", F.round("ndcg", 6).alias("ndcg"))


@query(DENSE + """, g AS (SELECT de.*, CASE WHEN a.label = b.label THEN CASE WHEN de.docid % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS grade FROM de JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = docid),
x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, rank) AS best, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM g)
SELECT 'dense' AS system, qid, round(round(coalesce(sum(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN best <= 10 THEN grade / log2(best + 1) ELSE 0 END), 0), 0), 9), 6) AS ndcg,
round(coalesce(sum(CASE WHEN grade > 0 THEN hits / CAST(rank AS DOUBLE) END) / nullif(sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END), 0), 0), 6) AS ap, max(CASE WHEN rank = 1 AND grade > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS p_1, round(coalesce(1 / CAST(min(CASE WHEN grade > 0 THEN rank END) AS DOUBLE), 0), 6) AS mrr FROM x GROUP BY qid""")
def graded_linear(spark, d):
    """Linear gains, with average precision, precision at 1 and the reciprocal rank of the same lists."""
    run = written(_dense_ranked(spark, d).withColumn("system", F.lit("dense")), "run")
    g = _labels(spark, d, run).withColumn("grade", F.when(F.col("docid") % 2 == 0, 2).otherwise(1))
    r = m.graded_ndcg(run, g, 10, exponential=False)
    return r.select("system", "qid", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap")], "p_1", F.round("mrr", 6).alias("mrr"))


@query(PER + """, b AS (SELECT system, CASE WHEN first_rank < 0 THEN 'missing' WHEN first_rank = 1 THEN '1' WHEN first_rank <= 5 THEN '2-5' WHEN first_rank <= 10 THEN '6-10' WHEN first_rank <= 100 THEN '11-100' ELSE '>100' END AS bucket FROM per)
SELECT system, bucket, count(*) AS queries, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY system) AS DOUBLE), 6) AS share FROM b GROUP BY system, bucket""")
def rank_buckets(spark, d):
    return m.rank_buckets(_per(spark, d)).withColumn("share", F.round("share", 6))


QTEXT = "qx AS (SELECT qid, min(text) AS text FROM (SELECT qid, text FROM en_train UNION ALL SELECT qid, text FROM en_eval) WHERE text IS NOT NULL AND qid IS NOT NULL GROUP BY qid)"


def _texts(spark, d):
    a, b = table(spark, d, "en_train").select("qid", "text"), table(spark, d, "en_eval").select("qid", "text")
    return a.unionByName(b).where("text is not null and qid is not null").groupBy("qid").agg(F.min("text").alias("text"))


BUCKET = """ SELECT system, bucket, count(*) AS queries, round(avg(mrr_5), 6) AS mean, round(CAST(1.96 AS DOUBLE) * coalesce(stddev_samp(mrr_5), 0) / sqrt(count(*)), 6) AS ci95 FROM per JOIN b USING (qid) GROUP BY system, bucket"""


@query(PER + f""", {QTEXT}, b AS (SELECT qid, CASE WHEN n <= 20 THEN '1-20' WHEN n <= 34 THEN '21-34' ELSE '35+' END AS bucket FROM (SELECT qid, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{85}}\\x{{0b}}\\x{{1c}}-\\x{{1f}}]+'), lambda x: x <> '')) AS n FROM qx))""" + BUCKET)
def query_length_buckets(spark, d):
    n = token_count("text")
    b = F.when(n <= 20, "1-20").when(n <= 34, "21-34").otherwise("35+")
    return m.by_bucket(_per(spark, d), _texts(spark, d), b).select("system", "bucket", "queries", F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95"))


@query(PER + f""", {QTEXT}, b AS (SELECT qid, CASE WHEN {cues_sql('text')} >= 4 THEN 'entity-rich' ELSE 'entity-sparse' END AS bucket FROM qx)""" + BUCKET)
def entity_cue_buckets(spark, d):
    b = F.when(entity_cues("text") >= 4, "entity-rich").otherwise("entity-sparse")
    return m.by_bucket(_per(spark, d), _texts(spark, d), b).select("system", "bucket", "queries", F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95"))


@query(f"WITH {QTEXT} SELECT CAST(floor(length(text) / 20) * 20 AS BIGINT) AS bin, count(*) AS n FROM qx GROUP BY 1")
def length_histogram(spark, d):
    return m.histogram(_texts(spark, d).select(F.length("text").alias("n_chars")), "n_chars", 20)


def _scores(spark, d, metric="ndcg_10"):
    return _per(spark, d).select("system", "qid", F.col(metric).alias("score"))


SC = PER + ", sc AS (SELECT system, qid, ndcg_10 AS score FROM per)"


@query(SC + " SELECT system, count(*) AS queries, round(avg(score), 6) AS mean, median(score) AS median, round(coalesce(stddev_samp(score), 0), 6) AS std_dev, min(score) AS min, max(score) AS max FROM sc GROUP BY system")
def summary_by_system(spark, d):
    s = st.summary(_scores(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})


# The t quantile at 0.975 as a series about the normal one, in the reciprocal of the degrees of freedom.
Z, NU = "CAST(1.959963984540054 AS DOUBLE)", "CAST(n - 1 AS DOUBLE)"
T_QUANTILE = f"({Z} + ({Z}^3 + {Z}) / (4 * {NU}) + (5 * {Z}^5 + 16 * {Z}^3 + 3 * {Z}) / (96 * {NU}^2) + (3 * {Z}^7 + 19 * {Z}^5 + 17 * {Z}^3 - 15 * {Z}) / (384 * {NU}^3))"


@query(SC + f""", s AS (SELECT system, count(*) AS n, avg(score) AS m, median(score) AS md, round(coalesce(stddev_samp(score), 0), 9) AS sd, min(score) AS lo, max(score) AS hi FROM sc GROUP BY system)
SELECT system, n AS queries, round(m, 6) AS mean, md AS median, round(sd, 6) AS std_dev, lo AS min, hi AS max, round(m - {T_QUANTILE} * sd / sqrt(n), 6) AS ci_low, round(m + {T_QUANTILE} * sd / sqrt(n), 6) AS ci_high FROM s""")
def summary_t_interval(spark, d):
    s = st.with_t_interval(st.summary(_scores(spark, d)))
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "std_dev", "ci_low", "ci_high")})


@query(SC + " SELECT count(DISTINCT system) AS systems, count(DISTINCT qid) AS queries, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, sum(n) = count(DISTINCT system) * count(DISTINCT qid) AND sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) = 0 AS complete FROM (SELECT system, qid, count(*) AS n FROM sc GROUP BY system, qid)")
def complete_blocks(spark, d):
    return st.checked_blocks(_scores(spark, d))


ANOVA = SC + """, g AS (SELECT avg(score) AS g, sum(score * score) AS sq, count(*) AS n FROM sc), s AS (SELECT sum(m * m) AS s, count(*) AS k FROM (SELECT avg(score) AS m FROM sc GROUP BY system)), q AS (SELECT sum(m * m) AS q, count(*) AS b FROM (SELECT avg(score) AS m FROM sc GROUP BY qid)),
x AS (SELECT b * (s - k * g * g) AS a, k * (q - b * g * g) AS c, sq - n * g * g AS t, k - 1 AS da, b - 1 AS dc, b FROM g, s, q), y AS (SELECT *, t - a - c AS e, da * dc AS de FROM x)"""


@query(ANOVA + """ SELECT 'system' AS source, round(a, 6) AS sum_sq, CAST(da AS BIGINT) AS df, round(a / da / (e / de), 6) AS f FROM y UNION ALL SELECT 'query', round(c, 6), CAST(dc AS BIGINT), round(c / dc / (e / de), 6) FROM y UNION ALL SELECT 'residual', round(e, 6), CAST(de AS BIGINT), NULL FROM y""")
def anova_blocks(spark, d):
    return st.anova(_scores(spark, d))


def simpson(density: str, upto: str, steps: int = 4000) -> str:
    """The integral of a density of t from 0 to a value, by Simpson's rule."""
    terms = f"list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density.format(t=f'(greatest(i, 1e-9) * ({upto}) / {steps})')})"
    return f"(list_sum({terms}) * ({upto}) / {3 * steps})"


F_TAIL = "greatest(0, 1 - " + simpson("exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln({t}) + (b - 1) * ln(1 - {t}))", "least(x, 0.999999)", 20000) + ")"


@query(ANOVA + f""", r AS (SELECT 'system' AS source, a AS ss, da AS df, a / da / (e / de) AS f, de FROM y UNION ALL SELECT 'query', c, dc, c / dc / (e / de), de FROM y),
gx AS (SELECT *, df / CAST(2 AS DOUBLE) AS a, de / CAST(2 AS DOUBLE) AS b, df * f / (df * f + de) AS x FROM r)
SELECT source, round(ss, 6) AS sum_sq, CAST(df AS BIGINT) AS df, round(f, 6) AS f, round({F_TAIL}, 4) AS p FROM gx UNION ALL SELECT 'residual', round(e, 6), CAST(de AS BIGINT), NULL, NULL FROM y""")
def anova_p_values(spark, d):
    return st.anova_p_values(st.anova(_scores(spark, d))).withColumn("p", F.round("p", 4))


@query(ANOVA + """, mm AS (SELECT system, avg(score) AS m, count(*) AS b FROM sc GROUP BY system) SELECT i.system AS group1, j.system AS group2, round(j.m - i.m, 6) AS mean_diff, round(round(abs(j.m - i.m) / sqrt((SELECT round(e, 6) / de FROM y) / i.b), 5), 4) AS q FROM mm i JOIN mm j ON i.system < j.system""")
def tukey_q(spark, d):
    return st.tukey(_scores(spark, d)).select("group1", "group2", F.round("mean_diff", 6).alias("mean_diff"), F.round("q", 4).alias("q"))


@query()
def tukey_hsd(spark, d):
    s = _scores(spark, d)
    r = st.checked_blocks(s).first()
    return st.tukey_p_values(st.tukey(s), r.systems, (r.systems - 1) * (r.queries - 1))


CHI_TAIL = "greatest(0, 1 - " + simpson("exp((k / 2 - 1) * ln({t}) - {t} / 2 - k / 2 * ln(2) - lgamma(k / 2))", "c") + ")"
FRIEDMAN = SC + """, r AS (SELECT system, qid, score, rank() OVER (PARTITION BY qid ORDER BY score) + (count(*) OVER (PARTITION BY qid, score) - 1) / CAST(2 AS DOUBLE) AS r FROM sc),
s AS (SELECT sum(s * s) AS ss, count(*) AS k FROM (SELECT sum(r) AS s FROM r GROUP BY system)), t AS (SELECT sum(t * t * t - t) AS tt, count(DISTINCT qid) AS n FROM (SELECT qid, count(*) AS t FROM sc GROUP BY qid, score))
SELECT k AS systems, n AS queries, CASE WHEN k < 3 THEN NULL WHEN 1 - tt / (CAST(n AS DOUBLE) * k * (k * k - 1)) <= 1e-12 THEN 0 ELSE round((12 / (CAST(n AS DOUBLE) * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - tt / (CAST(n AS DOUBLE) * k * (k * k - 1))), 4) END AS statistic, CASE WHEN k < 3 THEN 'fewer than three systems' ELSE '' END AS note FROM s, t"""


@query(FRIEDMAN)
def friedman(spark, d):
    return st.friedman(_scores(spark, d)).withColumn("statistic", F.round("statistic", 4))


@query(f"WITH fr AS ({FRIEDMAN}), c AS (SELECT *, statistic AS c, CAST(systems - 1 AS DOUBLE) AS k FROM fr) SELECT systems, queries, statistic, CASE WHEN statistic = 0 THEN 1 ELSE round({CHI_TAIL}, 6) END AS p, note FROM c")
def friedman_p_value(spark, d):
    return st.friedman_p_value(st.friedman(_scores(spark, d))).withColumns({"statistic": F.round("statistic", 4), "p": F.round("p", 6)})


WIL = SC + """, dd AS (SELECT a.system AS group1, b.system AS group2, round(b.score - a.score, 9) AS d FROM sc a JOIN sc b ON a.qid = b.qid AND a.system < b.system),
rk AS (SELECT *, abs(d) AS a, rank() OVER (PARTITION BY group1, group2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY group1, group2, abs(d)) - 1) / CAST(2 AS DOUBLE) AS r FROM dd),
ti AS (SELECT group1, group2, sum(t * t * t - t) AS tt FROM (SELECT group1, group2, a, count(*) AS t FROM rk WHERE a > 0 GROUP BY ALL) GROUP BY group1, group2),
gr AS (SELECT group1, group2, count(*) AS n, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS losses, sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS ties, round(avg(d), 6) AS mean_diff, round(avg(d) - CAST(1.96 AS DOUBLE) * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS ci_low, round(avg(d) + CAST(1.96 AS DOUBLE) * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS ci_high, round(median(d), 6) AS median_diff, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS down FROM rk GROUP BY group1, group2),
wi AS (SELECT *, least(up, down) AS w, CAST(n AS DOUBLE) * (n + 1) / 4 - CAST(ties AS DOUBLE) * (ties + 1) / 4 AS mu, (CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) - CAST(ties AS DOUBLE) * (ties + 1) * (2 * ties + 1) - coalesce(tt, 0) / CAST(2 AS DOUBLE)) / 24 AS var FROM gr LEFT JOIN ti USING (group1, group2)),
wz AS (SELECT *, CASE WHEN var > 0 THEN round((w - mu) / sqrt(var), 6) ELSE 0 END AS z FROM wi)"""


@query(WIL + " SELECT group1, group2, n, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(ties AS BIGINT) AS ties, mean_diff, ci_low, ci_high, median_diff, w, round(z, 4) AS z FROM wz")
def wilcoxon_pratt(spark, d):
    w = _tested(spark, d, _hit_scores(spark, d))
    return w.withColumns({"mean_diff": F.round("mean_diff", 6), "ci_low": F.round("ci_low", 6), "ci_high": F.round("ci_high", 6), "median_diff": F.round("median_diff", 6), "z": F.round("z", 4)})


NORMAL_TAIL = "greatest(0, 1 - 2 / sqrt(2 * pi()) * " + simpson("exp(-{t} * {t} / 2)", "least(abs(z), 12)") + ")"


@query(WIL + f""", p AS (SELECT group1, group2, w, z, {NORMAL_TAIL} AS p FROM wz), s AS (SELECT *, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1), 1) AS step FROM p)
SELECT group1, group2, w, round(z, 4) AS z, round(p, 6) AS p, round(max(step) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm, max(step) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) < 0.05 AS reject FROM s""")
def wilcoxon_holm(spark, d):
    t_ = st.holm(st.with_normal_p(_tested(spark, d, _hit_scores(spark, d))))
    return t_.select("group1", "group2", "w", F.round("z", 4).alias("z"), F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"), "reject")


@query(WIL + """, p AS (SELECT group1, group2, round(exp(-abs(z)), 6) AS p FROM wz), s AS (SELECT *, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p) + 1), 1) AS step FROM p)
SELECT group1, group2, p, round(max(step) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")
def holm_steps(spark, d):
    """The step-down adjustment, on a stand-in p that both engines can compute."""
    p = _tested(spark, d, _hit_scores(spark, d)).select("group1", "group2", F.round(F.exp(-F.abs("z")), 6).alias("p"))
    return st.holm(p).select("group1", "group2", "p", F.round("p_holm", 6).alias("p_holm"))


@query(SC + """, b AS (SELECT qid, score AS b FROM sc WHERE system = 'hybrid_513_b0001'), x AS (SELECT system, round(score - b, 9) AS d FROM sc JOIN b USING (qid) WHERE system <> 'hybrid_513_b0001')
SELECT system, count(*) AS queries, round(avg(d), 6) AS mean_delta, round(CAST(1.96 AS DOUBLE) * coalesce(stddev_samp(d), 0) / sqrt(count(*)), 6) AS ci95, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM x GROUP BY system""")
def baseline_delta(spark, d):
    b = st.baseline_delta(_scores(spark, d), "hybrid_513_b0001")
    return b.withColumns({"mean_delta": F.round("mean_delta", 6), "ci95": F.round("ci95", 6)})


MATRIX = ["mrr_5", "ap", "ndcg_10", "recall_5", "recall_10", "recall_100"]


@query(PER + " SELECT system, " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in MATRIX) + " FROM per GROUP BY system")
def metric_matrix_pivot(spark, d):
    x = st.metric_matrix(m.long_form(_per(spark, d), MATRIX), MATRIX)
    return x.select("system", *[F.round(c, 6).alias(c) for c in MATRIX])


@query(WIL + " SELECT group1 AS row, group2 AS col, mean_diff AS value FROM wz UNION ALL SELECT group2, group1, mean_diff FROM wz UNION ALL SELECT DISTINCT system, system, CAST(1 AS DOUBLE) FROM sc")
def symmetric_matrix(spark, d):
    names, n = written(t.systems(spark, d), "systems"), t.judged(spark, d).count()
    w = st.mean_differences(_hit_scores(spark, d), names, n).select("group1", "group2", F.round("mean_diff", 6).alias("value"))
    return st.symmetric_matrix(w, "value", names.where(F.lit(n > 0)))


@query(SC + " SELECT system, min(score) AS lowest, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q3, max(score) AS highest FROM sc GROUP BY system")
def five_numbers(spark, d):
    f = st.five_numbers(_scores(spark, d))
    return f.select("system", "lowest", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "highest")


@query(SC + " SELECT system, qid, round(score - avg(score) OVER (PARTITION BY system) - avg(score) OVER (PARTITION BY qid) + avg(score) OVER (), 6) AS residual FROM sc")
def block_residuals(spark, d):
    return st.residuals(_scores(spark, d)).select("system", "qid", F.round("residual", 6).alias("residual"))


@query(PER + " SELECT round(corr(recall_100, mrr_5), 4) AS mrr_5, round(corr(recall_100, ndcg_10), 4) AS ndcg_10, round(corr(recall_100, ap), 4) AS ap FROM per")
def param_corr(spark, d):
    c = st.correlations(_per(spark, d), "recall_100", ["mrr_5", "ndcg_10", "ap"])
    return c.select(*[F.round(x, 4).alias(x) for x in c.columns])


@query(ANOVA + """, mm AS (SELECT system, avg(score) AS m, count(*) AS b FROM sc GROUP BY system)
SELECT i.system AS group1, j.system AS group2, round(i.m, 6) AS mean1, round(j.m, 6) AS mean2, round(j.m - i.m, 6) AS mean_diff, round(sqrt((SELECT round(e, 6) / de FROM y) / i.b), 6) AS se, i.b AS queries FROM mm i JOIN mm j ON i.system < j.system""")
def tukey_means(spark, d):
    """The part of the full comparison table that plain SQL can state; p-values and limits are in ``tukey_table``."""
    r = st.tukey_report(_scores(spark, d))
    return r.select("group1", "group2", *[F.round(c, 6).alias(c) for c in ("mean1", "mean2", "mean_diff", "se")], "queries")


@query()
def tukey_table(spark, d):
    """All fourteen columns for each pair of systems."""
    return st.tukey_report(_scores(spark, d))


@query(PER + """, x AS (SELECT recall_100 AS y, mrr_5 AS a, ap AS b FROM per),
m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(y) AS yy FROM x),
s AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ba, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS bb2 FROM m), f AS (SELECT *, my - ba * ma - bb2 * mb AS b0, (ba * ya + bb2 * yb) / yy AS r2 FROM s)
SELECT 'intercept' AS term, round(b0, 5) AS coefficient, round(r2, 5) AS r2 FROM f UNION ALL SELECT 'mrr_5', round(ba, 5), round(r2, 5) FROM f UNION ALL SELECT 'ap', round(bb2, 5), round(r2, 5) FROM f""")
def param_regression(spark, d):
    r = st.least_squares(_per(spark, d), "recall_100", ["mrr_5", "ap"])
    return r.withColumns({"coefficient": F.round("coefficient", 5), "r2": F.round("r2", 5)})


def _metric_test(metric: str) -> str:
    return WIL.replace(SC, PER + f", sc AS (SELECT system, qid, {metric} AS score FROM per)") + f" SELECT '{metric}' AS metric, group1, group2, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, w, round(z, 4) AS z FROM wz"


@query(" UNION ALL ".join(f"SELECT * FROM ({_metric_test(x)})" for x in ("mrr_5", "ap")))
def metrics_tested(spark, d):
    """The paired test for several metrics, from one table of per-query metrics."""
    names, n = written(t.systems(spark, d), "systems"), t.judged(spark, d).count()
    long = m.long_form(written(_hits(spark, d).select("system", "qid", "mrr_5", "ap"), "per"), ["mrr_5", "ap"])
    out = st.by_metric(long, lambda s: st.wilcoxon_of_hits(s, names, n), ["mrr_5", "ap"])
    return out.select("metric", "group1", "group2", "wins", "losses", "w", F.round("z", 4).alias("z"))


@query(f"""WITH {t.RUNS}, {t.GOLDS}, c AS (SELECT r.qid, r.docid, r.rank, CASE WHEN g.docid IS NULL THEN 0 ELSE 1 END AS label FROM runs r LEFT JOIN golds g USING (qid, docid) WHERE system = 'hybrid_513_b0001' AND rank <= 20),
h AS (SELECT qid, max(label) AS p, min(label) AS n FROM c GROUP BY qid), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 1 / CAST(rank AS DOUBLE) DESC, docid) AS r FROM c), f AS (SELECT qid, min(r) AS r FROM k WHERE label > 0 AND r <= 10 GROUP BY qid)
SELECT CAST(sum(CASE WHEN p > 0 AND n <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS queries, CAST(sum(CASE WHEN p > 0 AND n <= 0 THEN 0 ELSE 1 END) AS BIGINT) AS skipped, round(coalesce(sum(CASE WHEN p > 0 AND n <= 0 THEN coalesce(1 / CAST(r AS DOUBLE), 0) END) / sum(CASE WHEN p > 0 AND n <= 0 THEN 1 ELSE 0 END), 0), 6) AS mrr FROM h LEFT JOIN f USING (qid)""")
def candidate_mrr(spark, d):
    """Reciprocal ranks over lists of positives and negatives; lists without either are skipped."""
    r = t.runs(spark, d).where("system = 'hybrid_513_b0001' and rank <= 20")
    g = t.golds(spark, d).withColumn("label", F.lit(1))
    c = r.join(g, ["qid", "docid"], "left").fillna(0, ["label"]).select("qid", "docid", "label", (1.0 / F.col("rank")).alias("score"))
    return m.candidate_mrr(c, 10).withColumn("mrr", F.round("mrr", 6))


@query(f"WITH {QTEXT}, b AS (SELECT CAST(floor(length(text) / 20) * 20 AS BIGINT) AS bin, count(*) AS n FROM qx GROUP BY 1) SELECT bin, n, (SELECT count(*) FROM qx) AS total, CAST((SELECT floor(median(length(text))) FROM qx) AS BIGINT) AS median FROM b")
def length_summary(spark, d):
    return m.length_summary(_texts(spark, d).select(F.length("text").alias("n_chars")), "n_chars", 20)


LANGS = "la AS (SELECT DISTINCT qid, split AS language FROM en_eval WHERE split IS NOT NULL)"


@query(PER + f""", {LANGS}, j AS (SELECT system, language, mrr_5, ap FROM per JOIN la USING (qid))
SELECT system, language, count(*) AS queries, round(avg(mrr_5), 6) AS mrr_5, round(avg(ap), 6) AS ap FROM j GROUP BY ALL UNION ALL SELECT system, 'all', count(*), round(avg(mrr_5), 6), round(avg(ap), 6) FROM j GROUP BY system""")
def micro_averages(spark, d):
    """By split, which stands for the language here, and over all queries of the splits together."""
    la = table(spark, d, "en_eval").where("split is not null").select("qid", F.col("split").alias("language")).distinct()
    a = m.micro_average(_per(spark, d), la, ["mrr_5", "ap"])
    return a.withColumns({c: F.round(c, 6) for c in ("mrr_5", "ap")})


@query(PER + """, a AS (SELECT system, avg(mrr_5) AS mrr_5, avg(ap) AS ap, avg(ndcg_10) AS ndcg_10 FROM per GROUP BY system), u AS (SELECT system, 'mrr_5' AS metric, mrr_5 AS v FROM a UNION ALL SELECT system, 'ap', ap FROM a UNION ALL SELECT system, 'ndcg_10', ndcg_10 FROM a)
SELECT x.metric, round(x.v, 6) AS first, round(y.v, 6) AS second, round(y.v - x.v, 6) AS delta FROM u x JOIN u y USING (metric) WHERE x.system = 'dense_m3_b0001' AND y.system = 'hybrid_513_b0001'""")
def metric_deltas(spark, d):
    """Two sets of metrics, asked for by their names in any spelling, and what changed."""
    per = written(_per(spark, d), "per")
    names = [m.metric_name(x) for x in ("MRR@5", "map", "nDCG-10")]

    def one(system: str) -> DataFrame:
        a = per.where(F.col("system") == system).agg(*[F.avg(x).alias(x) for x in names])
        return a.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{x}', {x}" for x in names) + ") as (metric, value)"))

    r = m.metric_delta(one("dense_m3_b0001"), one("hybrid_513_b0001"))
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("first", "second", "delta")])
