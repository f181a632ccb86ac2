"""Queries of retrieval, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaero.functions.text import STOPWORDS, expansion_views, reference_tokens, simple_tokens
from quaero.functions.vectors import blocks, unit
from quaero.operators import dense, fusion, index, rerank
from quaero.plans import tables as t
from quaero.plans.texts import VIEWS
from quaero.session import fingerprint, table, there, written
from quaero.sources.readers import search_filters

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple, index.Stored] = {}


def stored(spark: SparkSession, d: str) -> index.Stored:
    """The index over a directory's corpus: built by the first query that needs it, read by all later ones of the session while the corpus files are the same."""
    c = t.papers(spark, d)
    key = (spark.sparkContext.applicationId, fingerprint(c))
    if key not in _STORED or not there(spark, _STORED[key].path):
        _STORED[key] = index.stored(c, "docid", t.fields())
    return _STORED[key]


def _setup(spark: SparkSession, d: str):
    """Query terms, and the stored postings with their statistics and frequencies."""
    i = stored(spark, d)
    return index.query_terms(t.topics(spark, d), "qid", simple_tokens("query")), i.posts, i.statistics, i.frequencies


def _search(spark: SparkSession, d: str, boosts: dict[str, float] | None = None) -> DataFrame:
    terms, p, s, f = _setup(spark, d)
    return index.bm25_scores(terms, p, s, boosts, frequencies=f)


def _two_pass(spark: SparkSession, d: str) -> DataFrame:
    terms, p, s, f = _setup(spark, d)
    return index.two_pass(terms, p, s, docs_used=5, terms_used=10, k=100, frequencies=f)


def _out(df: DataFrame) -> DataFrame:
    return df.select("qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


BASE = f"WITH {t.CORPUS}, {t.POSTINGS}, {t.TOPIC_TERMS}, "
OUT = "SELECT qid, docid, round(score, 6) AS score, rank FROM "


@query(BASE + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 100) + " " + OUT + "h")
def bm25_topk(spark, d):
    return _out(index.ranked(_search(spark, d), 100))


@query(BASE + t.bm25_sql("qt", title=3.0) + ", " + t.ranked_sql("sc", "h", 50) + " " + OUT + "h")
def bm25_field_boost(spark, d):
    return _out(index.ranked(_search(spark, d, {"title": 3.0}), 50))


def clause_sql(text: str, weight: float, src: str) -> str:
    return f"SELECT qid, term, count(*) AS qtf, CAST({weight} AS DOUBLE) AS weight FROM (SELECT qid, unnest({t.tokens_sql(text)}) AS term FROM {src}) GROUP BY qid, term"


CLAUSES = f"""WITH {t.CORPUS}, {t.POSTINGS}, vw AS ({VIEWS}),
qt AS ({clause_sql('text', 0.3, 'shared_topics')} UNION ALL {clause_sql('expanded', 12.6, 'vw')} UNION ALL {clause_sql('sparse', 20.0, 'vw')}), """


@query(CLAUSES + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 50) + " " + OUT + "h")
def bm25_weighted_clauses(spark, d):
    """Original, expanded and sparse text of each query as three weighted clauses."""
    i = stored(spark, d)
    q = t.topics(spark, d).withColumn("v", expansion_views("query"))
    terms = index.weighted_clauses(q, "qid", {"original": (simple_tokens("query"), 0.3), "expanded": (simple_tokens("v.expanded"), 12.6), "sparse": (simple_tokens("v.sparse"), 20.0)})
    return _out(index.ranked(index.bm25_scores(terms, i.posts, i.statistics, frequencies=i.frequencies), 50))


FILTERED = f"""WITH {t.CORPUS}, {t.POSTINGS}, vw AS ({VIEWS}), qt AS ({clause_sql('text', 2.0, 'shared_topics')} UNION ALL {clause_sql('expanded', 1.0, 'vw')}), """


@query(FILTERED + t.bm25_sql("qt") + """, f AS (SELECT sc.* FROM sc JOIN corpus c USING (docid) WHERE lower(c.venue) = 'open letters in health' AND contains(lower(coalesce(c.authors, '')), 'a')), """ + t.ranked_sql("f", "h", 20) + " " + OUT + "h")
def bm25_parsed_filters(spark, d):
    """Two weighted clauses; venue and author are named in the query's text, parsed, and must hold."""
    i = stored(spark, d)
    named = t.topics(spark, d).select("qid", search_filters(F.concat("query", F.lit(' venue:"Open Letters in Health" author: A'))).alias("f"))
    q = named.select("qid", F.col("f.text").alias("query"), "f.venue", "f.author").withColumn("v", expansion_views("query"))
    terms = index.weighted_clauses(q, "qid", {"original": (simple_tokens("query"), 2.0), "expanded": (simple_tokens("v.expanded"), 1.0)})
    scores = index.bm25_scores(terms, i.posts, i.statistics, frequencies=i.frequencies)
    return _out(index.ranked(index.must_hold(scores, q, t.papers(spark, d)), 20))


@query(BASE + t.bm25_sql("qt") + ", f AS (SELECT * FROM sc WHERE docid IN (SELECT docid FROM corpus WHERE lower(venue) = 'open letters in health')), " + t.ranked_sql("f", "h", 20) + " " + OUT + "h")
def bm25_filtered(spark, d):
    """A venue as a condition that must hold."""
    must = t.papers(spark, d).where(F.lower("venue") == "open letters in health").select("docid")
    return _out(index.ranked(_search(spark, d).join(must, "docid", "left_semi"), 20))


PRF = BASE + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 5) + """, fb AS (SELECT qid, term, sum(tf) AS freq FROM h JOIN po USING (docid) WHERE (qid, term) NOT IN (SELECT qid, term FROM qt) GROUP BY qid, term),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY freq DESC, term) AS pos FROM fb) WHERE pos <= 10)"""


@query(PRF + " SELECT qid, term, CAST(freq AS BIGINT) AS freq, pos FROM ft")
def prf_terms(spark, d):
    terms, p, s, f = _setup(spark, d)
    first = index.ranked(index.bm25_scores(terms, p, s, frequencies=f), 5)
    return index.feedback_terms(first, p, 5, 10, terms).select("qid", "term", "freq", F.col("pos").cast("bigint").alias("pos"))


PRF2 = PRF + ", q2 AS (SELECT qid, term, qtf, weight FROM qt UNION ALL SELECT qid, term, 1, CAST(1 AS DOUBLE) FROM ft), " + t.bm25_sql("q2", "sc2") + ", " + t.ranked_sql("sc2", "h2", 100)


@query(PRF2 + " " + OUT + "h2")
def prf_two_pass(spark, d):
    return _out(_two_pass(spark, d))


@query("""SELECT qid, CASE WHEN n <= 2 THEN 'SHORT_QUERY' WHEN n >= 5 THEN 'LONG_QUERY' WHEN regexp_matches(lower(text), 'vaccine|covid|medical|disease') THEN 'SCIENTIFIC_MEDICAL' ELSE 'BALANCED' END AS preset
FROM (SELECT qid, text, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM shared_topics)""")
def prf_adaptive_config(spark, d):
    return t.topics(spark, d).select("qid", index.preset_of(F.col("query")).alias("preset"))


def _preset_sql(n: int) -> str:
    return f"CASE preset " + " ".join(f"WHEN '{k}' THEN {v[n]}" for k, v in index.PRESETS.items()) + " END"


@query(BASE + t.bm25_sql("qt") + f""", ps AS (SELECT qid, CASE WHEN n <= 2 THEN 'SHORT_QUERY' WHEN n >= 5 THEN 'LONG_QUERY' WHEN regexp_matches(lower(text), 'vaccine|covid|medical|disease') THEN 'SCIENTIFIC_MEDICAL' ELSE 'BALANCED' END AS preset FROM (SELECT qid, text, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM shared_topics)),
h AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank, preset FROM sc JOIN ps USING (qid)) WHERE rank <= {_preset_sql(0)}),
fb AS (SELECT qid, preset, term, sum(tf) AS freq FROM h JOIN po USING (docid) WHERE (qid, term) NOT IN (SELECT qid, term FROM qt) GROUP BY ALL),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY freq DESC, term) AS pos FROM fb) WHERE pos <= {_preset_sql(1)}),
q2 AS (SELECT qid, term, qtf, weight FROM qt UNION ALL SELECT qid, term, 1, CAST(1 AS DOUBLE) FROM ft), {t.bm25_sql("q2", "sc2")},
h2 AS (SELECT * FROM (SELECT sc2.*, preset, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc2 JOIN ps USING (qid)) WHERE rank <= {_preset_sql(2)}) SELECT qid, docid, round(score, 6) AS score, rank, preset FROM h2""")
def prf_adaptive(spark, d):
    """Two-pass feedback, each query under the preset of its own text."""
    a = index.adaptive(t.topics(spark, d), "qid", "query", simple_tokens("query"), stored(spark, d))
    return a.select("qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), "preset")


@query(PRF + """ SELECT s.qid, CASE WHEN count(term) > 0 THEN any_value(s.text) || ' OR ' || string_agg(term, ' OR ' ORDER BY pos) ELSE any_value(s.text) END AS text FROM shared_topics s LEFT JOIN ft USING (qid) GROUP BY s.qid""")
def prf_query_text(spark, d):
    """The text of the second search, as a search engine would be given it."""
    terms, p, s, f = _setup(spark, d)
    more = index.feedback_terms(index.ranked(index.bm25_scores(terms, p, s, frequencies=f), 5), p, 5, 10, terms)
    lists = more.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("terms"))
    q = t.topics(spark, d).join(lists, "qid", "left")
    return q.select("qid", index.feedback_text(F.col("query"), F.coalesce("terms", F.array().cast("array<string>"))).alias("text"))


@query(PRF2 + ", b1 AS (SELECT qid, docid, rank, 0 AS src FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 20)"
  + """, u AS (SELECT qid, docid, min((src, rank)) AS a FROM (SELECT * FROM b1 UNION ALL SELECT qid, docid, rank, 1 FROM h2) GROUP BY qid, docid)
SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY a, docid) AS rank FROM u""")
def union_ordered_dedup(spark, d):
    return index.ordered_union(index.ranked(_search(spark, d), 20), _two_pass(spark, d)).select("qid", "docid", F.col("rank").cast("bigint").alias("rank"))


VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"
DENSE = f"""WITH {VEC}, sc AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_inner_product(a.e, b.e), 9) AS score FROM u a, u b WHERE a.vec_id <> b.vec_id),
de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 10)"""


def _dense(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return dense.dense_topk(e, e, "vec_id", "embedding", k + 1).where("qid <> docid").drop("rank")


def _dense_ranked(spark, d, k=10):
    return index.ranked(_dense(spark, d, k), k)


@query(DENSE + " SELECT qid, docid, round(score, 6) AS score, rank FROM de")
def dense_topk(spark, d):
    return _out(_dense_ranked(spark, d))


@query(DENSE + """, tk AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[8 * i + 1 : 8 * i + 8]) AS t FROM u)
SELECT qid, docid, round(round(list_avg(list_transform(a.t, lambda x: list_max(list_transform(b.t, lambda y: list_inner_product(x, y))))), 9), 6) AS score
FROM de JOIN tk a ON a.vec_id = qid JOIN tk b ON b.vec_id = docid""")
def late_interaction(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", blocks(unit(F.col("embedding")), 8).alias("tokens"))
    s = dense.late_interaction(_dense_ranked(spark, d), e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "docid"))
    return s.select("qid", "docid", F.round("score", 6).alias("score"))


SPARSE = """, w AS (SELECT vec_id, i AS token, e[i] AS weight FROM u, range(1, 65) r(i) WHERE e[i] > 0.1),
sp AS (SELECT de.qid, de.docid, round(coalesce(sum(a.weight * b.weight), 0), 9) AS score FROM de LEFT JOIN (w a JOIN w b ON a.token = b.token) ON a.vec_id = de.qid AND b.vec_id = de.docid GROUP BY ALL)"""


def _sparse(spark, d, pairs):
    w = table(spark, d, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("token", "weight")).where("weight > 0.1")
    return dense.sparse_scores(pairs, w.withColumnRenamed("vec_id", "qid"), w.withColumnRenamed("vec_id", "docid"))


@query(DENSE + SPARSE + " SELECT qid, docid, round(score, 6) AS score FROM sp")
def sparse_lexical_score(spark, d):
    return _sparse(spark, d, _dense_ranked(spark, d)).select("qid", "docid", F.round("score", 6).alias("score"))


@query(DENSE + SPARSE + """, tk AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[8 * i + 1 : 8 * i + 8]) AS t FROM u),
la AS (SELECT qid, docid, round(list_avg(list_transform(a.t, lambda x: list_max(list_transform(b.t, lambda y: list_inner_product(x, y))))), 9) AS score FROM de JOIN tk a ON a.vec_id = qid JOIN tk b ON b.vec_id = docid),
hy AS (SELECT qid, docid, round(de.score * CAST(0.5 AS DOUBLE) + sp.score * CAST(0.15 AS DOUBLE) + la.score * CAST(0.35 AS DOUBLE), 9) AS score FROM de JOIN sp USING (qid, docid) JOIN la USING (qid, docid)), """
  + t.ranked_sql("hy", "h", 5) + " SELECT qid, docid, round(score, 6) AS score, rank FROM h")
def hybrid_linear(spark, d):
    pool = written(_dense_ranked(spark, d), "pool")
    e = table(spark, d, "embeddings").select("vec_id", blocks(unit(F.col("embedding")), 8).alias("tokens"))
    late = dense.late_interaction(pool, e.withColumnRenamed("vec_id", "qid"), e.withColumnRenamed("vec_id", "docid"))
    return _out(dense.hybrid(pool, _sparse(spark, d, pool), late, 5))


VIEW = f"""WITH {VEC}, b AS (SELECT vec_id, label, e, list_transform(e, lambda x, i: x * (1 + (i % 3) * CAST(0.5 AS DOUBLE))) AS z FROM u), s AS (SELECT vec_id, list_transform(z, lambda x: x / sqrt(list_inner_product(z, z))) AS e FROM b),
sc AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_inner_product(a.e, b.e), 9) AS score FROM u a, u b), de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM sc) WHERE rank <= 15),
wq AS (SELECT vec_id, i AS token, e[i] AS weight FROM s, range(1, 65) r(i) WHERE e[i] > 0.1), wd AS (SELECT vec_id, i AS token, e[i] AS weight FROM u, range(1, 65) r(i) WHERE e[i] > 0.1),
sp AS (SELECT de.qid, de.docid, round(coalesce(sum(a.weight * b.weight), 0), 9) AS score FROM de LEFT JOIN (wq a JOIN wd b ON a.token = b.token) ON a.vec_id = de.qid AND b.vec_id = de.docid GROUP BY ALL),
tq AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[8 * i + 1 : 8 * i + 8]) AS t FROM s), td AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[8 * i + 1 : 8 * i + 8]) AS t FROM u),
la AS (SELECT qid, docid, round(list_avg(list_transform(a.t, lambda x: list_max(list_transform(b.t, lambda y: list_inner_product(x, y))))), 9) AS score FROM de JOIN tq a ON a.vec_id = qid JOIN td b ON b.vec_id = docid),
hy AS (SELECT qid, docid, round(de.score * CAST(0.5 AS DOUBLE) + sp.score * CAST(0.15 AS DOUBLE) + la.score * CAST(0.35 AS DOUBLE), 9) AS score FROM de JOIN sp USING (qid, docid) JOIN la USING (qid, docid)), """


@query(VIEW + t.ranked_sql("hy", "h", 5) + " SELECT qid, docid, round(score, 6) AS score, rank FROM h")
def hybrid_views(spark, d):
    """A view of the query for each signal: the sparse and the late signal read a reweighted vector."""
    e = table(spark, d, "embeddings").select("vec_id", unit(F.col("embedding")).alias("dense"))
    q = e.withColumn("other", F.transform("dense", lambda x, i: x * (1 + ((i + 1) % 3) * F.lit(0.5))))
    return _out(dense.hybrid_search(q, e, "vec_id", 5, 3, views=("dense", "other", "other")))


@query(f"WITH {t.RUNS} SELECT system, qid, docid, rank, score FROM runs")
def run_normalize(spark, d):
    return t.runs(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


RRF = f"""WITH {t.RUNS}, e AS (SELECT qid, docid, count(*) AS support, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS rrf, min(rank) AS best_rank, round(avg(rank), 9) AS mean_rank FROM runs GROUP BY qid, docid),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, rrf DESC, best_rank, mean_rank, docid) AS place FROM e)"""


@query(RRF + " SELECT qid, docid, support, round(rrf, 6) AS rrf, best_rank, round(mean_rank, 6) AS mean_rank, place FROM f WHERE place <= 20")
def rrf_fusion(spark, d):
    f = fusion.reciprocal_rank_fusion(t.runs(spark, d)).where("place <= 20")
    return f.select("qid", "docid", "support", F.round("rrf", 6).alias("rrf"), F.col("best_rank").cast("bigint").alias("best_rank"), F.round("mean_rank", 6).alias("mean_rank"), F.col("place").cast("bigint").alias("place"))


THREE = {"dense_m3_b0001": 0.5, "sparse_m3_b0001": 0.15, "colbert_m3_b0001": 0.35}


@query(f"""WITH {t.RUNS}, m AS (SELECT system, qid, docid, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM runs WHERE score IS NOT NULL AND system IN ('dense_m3_b0001', 'sparse_m3_b0001', 'colbert_m3_b0001') WINDOW w AS (PARTITION BY system, qid)),
x AS (SELECT qid, docid, CASE WHEN hi - lo > 1e-12 THEN (score - lo) / (hi - lo) ELSE 0 END * CASE system WHEN 'dense_m3_b0001' THEN CAST(0.5 AS DOUBLE) WHEN 'sparse_m3_b0001' THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.35 AS DOUBLE) END AS v FROM m),
s AS (SELECT qid, docid, round(sum(v), 9) AS score FROM x GROUP BY qid, docid), """ + t.ranked_sql("s", "h", 50) + " " + OUT + "h")
def fusion_minmax(spark, d):
    return _out(index.ranked(fusion.linear_fusion(t.runs(spark, d), THREE), 50))


@query(f"""WITH {t.RUNS}, a AS (SELECT qid, docid, rank, coalesce(score, 0) AS s0 FROM runs WHERE system = 'dense_m3_b0001'),
j AS (SELECT a.*, coalesce(b.score, 0) AS s1, coalesce(c.score, 0) AS s2 FROM a LEFT JOIN (SELECT * FROM runs WHERE system = 'sparse_m3_b0001') b USING (qid, docid) LEFT JOIN (SELECT * FROM runs WHERE system = 'colbert_m3_b0001') c USING (qid, docid)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS p, count(*) OVER w AS n, min(s0) OVER w AS a0, max(s0) OVER w AS b0, min(s1) OVER w AS a1, max(s1) OVER w AS b1, min(s2) OVER w AS a2, max(s2) OVER w AS b2 FROM j WINDOW w AS (PARTITION BY qid))
SELECT qid, docid, rank, s0, s1, s2, round(round(CASE WHEN b0 - a0 > 1e-12 THEN (s0 - a0) / (b0 - a0) ELSE 0 END, 9), 6) AS s0_minmax, round(round(CASE WHEN b1 - a1 > 1e-12 THEN (s1 - a1) / (b1 - a1) ELSE 0 END, 9), 6) AS s1_minmax, round(round(CASE WHEN b2 - a2 > 1e-12 THEN (s2 - a2) / (b2 - a2) ELSE 0 END, 9), 6) AS s2_minmax,
round(round(CASE WHEN n > 1 THEN 1 - CAST(p - 1 AS DOUBLE) / (n - 1) ELSE 1 END, 9), 6) AS rank_fraction, round(round(CAST(1 AS DOUBLE) / p, 9), 6) AS reciprocal_rank, round(round(1 / log2(p + 1), 9), 6) AS rank_discount FROM k""")
def fusion_rank_features(spark, d):
    f = fusion.fusion_features(t.runs(spark, d), "dense_m3_b0001", ["sparse_m3_b0001", "colbert_m3_b0001"])
    names = [c for c in f.columns if c not in ("qid", "docid", "rank", "s0", "s1", "s2")]
    return f.select("qid", "docid", F.col("rank").cast("bigint").alias("rank"), "s0", "s1", "s2", *[F.round(c, 6).alias(c) for c in names])


@query()
def fusion_learned(spark, d):
    f = fusion.fusion_features(t.runs(spark, d), "dense_m3_b0001", ["sparse_m3_b0001", "colbert_m3_b0001"])
    return fusion.learned_fusion(f, t.golds(spark, d))


@query(f"""WITH {t.RUNS}, q AS (SELECT DISTINCT qid FROM en_eval), s AS (SELECT DISTINCT system, qid FROM runs)
SELECT system, count(*) AS ranking_qids, count(q.qid) AS matched_qids, round(count(q.qid) / CAST((SELECT count(*) FROM q) AS DOUBLE), 6) AS coverage FROM s LEFT JOIN q USING (qid) GROUP BY system""")
def run_coverage(spark, d):
    return fusion.coverage(t.runs(spark, d), table(spark, d, "en_eval"))


@query(f"""WITH {t.RUNS}, s AS (SELECT DISTINCT system, qid FROM runs) SELECT system, (SELECT count(DISTINCT qid) FROM s) - count(*) AS missing FROM s GROUP BY system""")
def run_missing_queries(spark, d):
    return fusion.query_set_differences(t.runs(spark, d))


VOCAB = "list_distinct(list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}')))"
RERANK = BASE + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 50) + f""", tx AS (SELECT docid, concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), '')) AS text FROM corpus),
j AS (SELECT h.qid, h.docid, h.rank AS first, {VOCAB.format('s.text')} AS a, {VOCAB.format('tx.text')} AS b FROM h JOIN shared_topics s USING (qid) JOIN tx USING (docid) WHERE trim(tx.text) <> ''),
r AS (SELECT qid, docid, first, round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 9) AS score FROM j)
SELECT 'bm25' AS system, qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM r"""


def _texts(spark, d):
    c = t.corpus(spark, d)
    return c.select("docid", F.concat_ws(" ", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("abstract"), F.lit(""))).alias("text"))


@query(RERANK)
def rerank_stable(spark, d):
    run = index.ranked(_search(spark, d), 50).withColumn("system", F.lit("bm25"))
    out = rerank.rerank(run, t.topics(spark, d), _texts(spark, d))
    return out.select("system", "qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


RUN_TEXT = f"""WITH {t.RUNS}, {t.CORPUS}, tx AS (SELECT docid, concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), '')) AS text FROM corpus),
qs AS (SELECT DISTINCT qid, text AS query FROM en_eval WHERE trim(text) <> ''),
j AS (SELECT system, qid, docid, rank AS first, query, {VOCAB.format('query')} AS a, {VOCAB.format('tx.text')} AS b FROM runs LEFT JOIN qs USING (qid) LEFT JOIN tx USING (docid) WHERE query IS NULL OR trim(tx.text) <> ''),
r AS (SELECT system, qid, docid, first, CASE WHEN query IS NOT NULL THEN round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 9) END AS score FROM j),
o AS (SELECT system, qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC NULLS LAST, first) AS rank FROM r)
SELECT * FROM o WHERE rank <= 20"""


@query(RUN_TEXT)
def rerank_missing_text(spark, d):
    """Queries without text keep the order of the first stage; candidates without text go."""
    q = table(spark, d, "en_eval").where("trim(text) <> ''").select("qid", F.col("text").alias("query")).distinct()
    out = rerank.rerank(t.runs(spark, d), q, _texts(spark, d), k=20)
    return out.select("system", "qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(RUN_TEXT.replace("WHERE query IS NULL OR trim(tx.text) <> ''", "WHERE query IS NOT NULL AND trim(tx.text) <> ''"))
def rerank_dropped(spark, d):
    """Queries without text go, with their candidates."""
    q = table(spark, d, "en_eval").where("trim(text) <> ''").select("qid", F.col("text").alias("query")).distinct()
    out = rerank.rerank(t.runs(spark, d), q, _texts(spark, d), k=20, on_missing="drop")
    return out.select("system", "qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {t.RUNS}, {t.CORPUS}, tx AS (SELECT docid, concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), '')) AS text FROM corpus), qs AS (SELECT DISTINCT qid FROM en_eval WHERE trim(text) <> '')
SELECT system, count(*) AS entries, CAST(sum(CASE WHEN qs.qid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_query, CAST(sum(CASE WHEN tx.docid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_text FROM runs LEFT JOIN qs USING (qid) LEFT JOIN (SELECT * FROM tx WHERE trim(text) <> '') tx USING (docid) GROUP BY system""")
def rerank_missing_counts(spark, d):
    """Entries that cannot be scored, by what is missing."""
    q = table(spark, d, "en_eval").select("qid", F.col("text").alias("query"))
    return rerank.missing_texts(t.runs(spark, d), q, _texts(spark, d))


def lengths_model(prompts: list[str]) -> list[tuple[float, float]]:
    """A stand-in for a model with yes and no logits, which SQL can state too: the share of the prompt before the passage."""
    return [(4.0 * p.index("<Document>: ") / len(p), 1.0) for p in prompts]


@query(BASE + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 10) + f""", tx AS (SELECT docid, concat_ws(' ', nullif(trim(title), ''), nullif(trim(abstract), '')) AS text FROM corpus),
pr AS (SELECT h.qid, h.docid, h.rank AS first, '<Instruct>: Given a web search query, retrieve relevant passages that answer the query' || chr(10) || '<Query>: ' || s.text || chr(10) || '<Document>: ' AS head, tx.text AS body FROM h JOIN shared_topics s USING (qid) JOIN tx USING (docid) WHERE trim(tx.text) <> ''),
r AS (SELECT qid, docid, first, 1 / (1 + exp(1 - CAST(4 AS DOUBLE) * (length(head) - 12) / (length(head) + length(body)))) AS score FROM pr)
SELECT 'bm25' AS system, qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank FROM r""")
def rerank_prompted(spark, d):
    """A model that reads an instruction prompt and gives two logits; a stand-in takes its place."""
    run = written(index.ranked(_search(spark, d), 10).withColumn("system", F.lit("bm25")), "first")
    out = rerank.rerank(run, t.topics(spark, d), _texts(spark, d), rerank.prompted_scorer(lengths_model, "instruct", "yes_no"))
    return out.select("system", "qid", "docid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {t.RUNS}, s AS (SELECT DISTINCT system, qid FROM runs), n AS (SELECT system, count(*) AS n FROM s GROUP BY system), b AS (SELECT x.system AS group1, y.system AS group2, count(*) AS k FROM s x JOIN s y ON x.qid IS NOT DISTINCT FROM y.qid AND x.qid IS NOT NULL AND x.system < y.system GROUP BY ALL)
SELECT p.system AS group1, q.system AS group2, p.n - coalesce(k, 0) AS missing, q.n - coalesce(k, 0) AS extra FROM n p JOIN n q ON p.system < q.system LEFT JOIN b ON group1 = p.system AND group2 = q.system""")
def run_query_differences(spark, d):
    return fusion.symmetric_differences(t.runs(spark, d))


@query(BASE + t.bm25_sql("qt") + ", " + t.ranked_sql("sc", "h", 5) + f""", tk AS (SELECT docid, {t.tokens_sql('abstract')} AS tk FROM corpus),
x AS (SELECT h.qid, unnest(tk) AS term, rank, generate_subscripts(tk, 1) - 1 AS pos, greatest(1, CAST(round_even(5 * CAST(1 AS DOUBLE) / rank, 0) AS INT)) AS worth FROM h JOIN tk USING (docid)),
g AS (SELECT qid, term, sum(worth) AS weight, min((rank, pos)) AS f FROM x GROUP BY qid, term),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, f, term) AS p FROM g),
o AS (SELECT qid, term, weight, row_number() OVER (PARTITION BY qid ORDER BY p) AS pos FROM p WHERE p <= 30 AND (qid, term) NOT IN (SELECT qid, term FROM qt))
SELECT qid, term, CAST(weight AS BIGINT) AS weight, pos FROM o WHERE pos <= 15""")
def expansion_terms(spark, d):
    """Weighted terms of the five nearest documents; here the similarity is the reciprocal rank."""
    terms, p, s, f = _setup(spark, d)
    hits = index.ranked(index.bm25_scores(terms, p, s, frequencies=f), 5).withColumn("score", 1.0 / F.col("rank"))
    out = index.neighbour_terms(hits, t.corpus(spark, d), simple_tokens("abstract"), "docid", terms)
    return out.select("qid", "term", F.col("weight").cast("bigint").alias("weight"), F.col("pos").cast("bigint").alias("pos"))


@query()
def synonym_dictionary(spark, d):
    """A word model of all titles and abstracts, stop words included, and the entries of its dictionary: the near words of every term, by place."""
    dic = index.synonym_dictionary(t.corpus(spark, d), reference_tokens(F.concat_ws(" ", "title", "abstract")), stop=STOPWORDS)
    near = dic.select("term", F.posexplode("synonyms").alias("pos", "s"))
    return near.select("term", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("s.term").alias("synonym"), F.col("s.score").alias("score"))


@query(f"""WITH {t.TOPIC_TERMS}, {t.CORPUS}, ti AS (SELECT DISTINCT docid, unnest({t.tokens_sql('title')}) AS tt FROM corpus), ve AS (SELECT DISTINCT docid, unnest({t.tokens_sql('venue')}) AS ta FROM corpus),
n AS (SELECT tt, count(*) AS n FROM ti GROUP BY tt), c AS (SELECT tt, ta, count(*) AS c FROM ti JOIN ve USING (docid) GROUP BY tt, ta), sc AS (SELECT tt, ta, round(c / CAST(n AS DOUBLE), 6) AS s FROM c JOIN n USING (tt)),
k AS (SELECT *, row_number() OVER (PARTITION BY tt ORDER BY s DESC, ta) AS k FROM sc),
x AS (SELECT qid, term AS s FROM qt UNION SELECT qid, ta FROM qt JOIN k ON tt = term WHERE k <= 3 AND s >= 0.2) SELECT qid, array_to_string(list_sort(list_distinct(list(s))), ' ') AS terms FROM x GROUP BY qid""")
def synonym_expand(spark, d):
    """Dictionary expansion; the dictionary gives each title word the words of the venues it stands with, scored by their share of its papers. The first three count, if they reach the threshold."""
    c = t.corpus(spark, d)
    a = written(c.select("docid", F.explode(simple_tokens("title")).alias("term")).distinct(), "words")
    b = c.select("docid", F.explode(simple_tokens("venue")).alias("s")).distinct()
    both = a.join(b, "docid").groupBy("term", "s").agg(F.count("*").alias("c")).join(a.groupBy("term").agg(F.count("*").alias("n")), "term")
    w = Window.partitionBy("term").orderBy(F.col("score").desc(), "s")
    best = both.select("term", "s", F.round(F.col("c") / F.col("n"), 6).alias("score")).withColumn("k", F.row_number().over(w)).where("k <= 5")
    dic = best.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s", "score"))), lambda x: F.struct(x["s"].alias("term"), x["score"].alias("score"))).alias("synonyms"))
    terms = index.query_terms(t.topics(spark, d), "qid", simple_tokens("query"))
    return index.synonym_terms(terms, dic, 3, 0.2).select("qid", F.array_join("terms", " ").alias("terms"))
