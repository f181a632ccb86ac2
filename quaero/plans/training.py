"""Queries of training sets and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.functions.text import clean_post
from quaero.operators import augmentation, fusion, quality
from quaero.operators import training as tr
from quaero.plans import tables as t
from quaero.plans.retrieval import DENSE, _dense_ranked
from quaero.plans.texts import post_sql, ws
from quaero.session import table, written
from quaero.sources import sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _long(df, *cs):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cs})


@query("SELECT DISTINCT qid, pubkey AS docid, CAST(1 AS BIGINT) AS relevance FROM en_train WHERE pubkey IS NOT NULL AND qid IS NOT NULL")
def qrels(spark, d):
    return _long(tr.qrels_of(table(spark, d, "en_train")), "relevance")


@query("SELECT DISTINCT qid, text FROM en_train WHERE trim(text) <> '' AND pubkey IN (SELECT pubkey FROM collection_data)")
def gold_semi_join(spark, d):
    """Queries whose gold paper is in the corpus."""
    q = table(spark, d, "en_train").where("trim(text) <> ''")
    return q.join(table(spark, d, "collection_data").select("pubkey"), "pubkey", "left_semi").select("qid", "text").distinct()


@query(f"WITH {t.RUNS}, {t.CORPUS} SELECT system, count(*) AS entries, count(DISTINCT docid) AS documents FROM runs WHERE docid NOT IN (SELECT docid FROM corpus) GROUP BY system")
def gold_anti_join(spark, d):
    """Documents of runs that the corpus lacks."""
    r = t.runs(spark, d).join(t.keys(spark, d), "docid", "left_anti")
    return r.groupBy("system").agg(F.count("*").alias("entries"), F.countDistinct("docid").alias("documents"))


@query("""WITH k AS (SELECT pubkey, coalesce(nullif(trim(title), ''), '') || '|' || coalesce(nullif(trim(abstract), ''), '') AS t FROM collection_data)
SELECT pubkey AS docid, min(t) AS text, count(*) AS delivered FROM k WHERE t <> '|' GROUP BY pubkey""")
def doc_dedup_first(spark, d):
    """One row for each paper key that has text."""
    c = table(spark, d, "collection_data")
    text = F.concat_ws("|", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("")), F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), F.lit("")))
    return c.select(F.col("pubkey").alias("docid"), text.alias("text")).where("text <> '|'").groupBy("docid").agg(F.min("text").alias("text"), F.count("*").alias("delivered"))


def _cand(spark, d):
    r = t.runs(spark, d).where("system = 'hybrid_513_b0001'")
    return tr.candidate_negatives(r, t.golds(spark, d), t.keys(spark, d))


def cand_sql(where: str, by: str) -> str:
    """CTEs of a run's usable candidates and of their offset negatives na (by..., docid, kind, pos)."""
    return f"""cd AS (SELECT system, qid, docid, rank, row_number() OVER (PARTITION BY system, qid ORDER BY rank) AS pos FROM runs WHERE {where} docid IN (SELECT docid FROM corpus) AND (qid, docid) NOT IN (SELECT qid, docid FROM golds)),
cn AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM cd), ch AS (SELECT *, CASE WHEN n >= 6 THEN 1 ELSE 0 END AS s FROM cn WHERE n >= 7),
na AS (SELECT {by}, docid, CASE WHEN pos > s AND pos <= s + 5 THEN 'hard' ELSE 'soft' END AS kind, pos FROM ch WHERE pos > s AND pos <= s + 5 OR pos > 10 AND pos <= 15)"""


ONE_RUN = "system = 'hybrid_513_b0001' AND"
TABLES = f"WITH {t.RUNS}, {t.GOLDS}, {t.CORPUS}"
CAND = f"{TABLES}, {cand_sql(ONE_RUN, 'qid')}, ng AS (SELECT * FROM na)"
CAND_ALL = f"{TABLES}, {cand_sql('', 'system, qid')}, ng AS (SELECT qid, docid, min(kind) AS kind FROM na GROUP BY qid, docid)"


def _cand_all(spark, d):
    return tr.candidate_negatives(t.runs(spark, d), t.golds(spark, d), t.keys(spark, d))


@query(f"""{TABLES}, c AS (SELECT system, qid, docid, rank, row_number() OVER (PARTITION BY system, qid ORDER BY rank) AS pos FROM runs WHERE rank <= 50 AND docid IN (SELECT docid FROM corpus) AND (qid, docid) NOT IN (SELECT qid, docid FROM golds)) SELECT system, qid, docid, rank, pos FROM c WHERE pos <= 5""")
def neg_candidates_per_run(spark, d):
    """The five first usable candidates among the fifty first of every list."""
    c = tr.candidate_negatives(t.runs(spark, d), t.golds(spark, d), t.keys(spark, d), depth=50, per_run=5)
    return _long(c.select("system", "qid", "docid", "rank", "pos"), "rank", "pos")


@query(CAND + " SELECT qid, docid, kind, pos FROM ng")
def neg_offsets(spark, d):
    return _long(tr.offset_negatives(_cand(spark, d)), "pos")


# Keys of normalised texts, and the fused evidence of all runs.
KEYS = """tx AS (SELECT docid, min(md5(lower(regexp_replace(regexp_replace(coalesce(title, '') || ' ' || coalesce(abstract, ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')))) AS key FROM corpus GROUP BY docid),
g AS (SELECT DISTINCT qid, key FROM golds JOIN tx USING (docid))"""
EVIDENCE = """e AS (SELECT qid, docid, count(*) AS support, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS rrf, min(rank) AS br, round(avg(rank), 9) AS mr FROM runs GROUP BY qid, docid),
f AS (SELECT qid, docid, support, row_number() OVER (PARTITION BY qid ORDER BY support DESC, rrf DESC, br, mr, docid) AS place FROM e)"""


def chosen_sql(pool: str) -> str:
    """CTEs from a pool (qid, docid, stage, p, support) to w (..., place): one candidate for each text, none with a positive's."""
    return f"""p AS (SELECT q.*, key FROM ({pool}) q JOIN tx USING (docid)), fr AS (SELECT p.* FROM p LEFT JOIN g USING (qid, key) LEFT JOIN (SELECT qid, docid, 1 AS y FROM golds) z USING (qid, docid) WHERE g.qid IS NULL AND y IS NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY stage, p, docid) AS k FROM fr), w AS (SELECT qid, docid, stage, support, row_number() OVER (PARTITION BY qid ORDER BY stage, p, docid) AS place FROM o WHERE k = 1)"""


FROM_RUNS = "SELECT qid, docid, 1 AS stage, place AS p, support FROM f"
FUSED = f"{TABLES}, {KEYS}, {EVIDENCE}, {chosen_sql(FROM_RUNS)}"


def _fused(spark, d, n=10, fill=None):
    c = t.corpus(spark, d)
    texts = c.select("docid", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text")).groupBy("docid").agg(F.min("text").alias("text"))
    return tr.fused_negatives(t.runs(spark, d), t.golds(spark, d), texts, n, fill=fill)


@query(FUSED + " SELECT qid, docid, CAST(stage AS BIGINT) AS stage, place FROM w WHERE place <= 10")
def neg_fused(spark, d):
    return _long(_fused(spark, d), "stage", "place").select("qid", "docid", "stage", "place")


def _paper_texts(spark, d):
    c = t.corpus(spark, d)
    return c.select("docid", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))).alias("text"))


def _fused_filled(spark, d, n=10):
    """Candidates of all runs, then the offset negatives of one run, then random documents, for every query of the runs and every judged one."""
    q = t.runs(spark, d).select("qid").union(t.judged(spark, d).select("qid"))
    return tr.filled_negatives(q, t.runs(spark, d), t.golds(spark, d), _paper_texts(spark, d), n, base=tr.offset_negatives(_cand(spark, d)))


RING = """{r} AS (SELECT docid, row_number() OVER (ORDER BY md5('42_' || docid), docid) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT docid FROM {src} WHERE docid IS NOT NULL))"""
START = "CAST('0x' || substr(md5('42_' || qid), 1, 8) AS BIGINT)"


def drawn_sql(need: str, ring: str, out: str) -> str:
    """CTE (qid, docid, step) for a CTE (qid, steps)."""
    return f"""{out}s AS (SELECT qid, step, (CAST('0x' || substr(md5('42_' || qid), 1, 8) AS BIGINT) % total + step) % total AS place FROM {need}, (SELECT max(total) AS total FROM {ring}) tt, LATERAL (SELECT unnest(range(0, least(steps, total))) AS step)),
{out} AS (SELECT qid, docid, step FROM {out}s JOIN {ring} USING (place))"""


WITH_BASE = FROM_RUNS + " UNION ALL SELECT qid, docid, 2, pos, NULL FROM na"
FILLED = f"""{TABLES}, {KEYS}, {EVIDENCE}, {cand_sql(ONE_RUN, 'qid')}, {chosen_sql(WITH_BASE)}, {t.JUDGED}, cu AS (SELECT * FROM w WHERE place <= 10),
asked AS (SELECT DISTINCT qid FROM runs WHERE qid IS NOT NULL UNION SELECT qid FROM judged), sh AS (SELECT a.qid, coalesce(c, 0) AS have FROM asked a LEFT JOIN (SELECT qid, count(*) AS c FROM cu GROUP BY qid) USING (qid) WHERE coalesce(c, 0) < 10),
{RING.format(r="rg", src="tx")}, nd AS (SELECT qid, (SELECT count(*) FROM tx) AS steps FROM sh), {drawn_sql("nd", "rg", "dr")},
us AS (SELECT DISTINCT qid, key FROM cu JOIN tx USING (docid) UNION SELECT qid, key FROM g), ok AS (SELECT dr.qid, docid, step, key FROM dr JOIN tx USING (docid) ANTI JOIN golds USING (qid, docid)), ov AS (SELECT * FROM ok ANTI JOIN us USING (qid, key)),
ou AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY step) AS k FROM ov), mo AS (SELECT qid, docid, have + row_number() OVER (PARTITION BY qid ORDER BY step) AS place FROM ou JOIN sh USING (qid) WHERE k = 1),
al AS (SELECT qid, docid, stage, place, support FROM cu UNION ALL SELECT qid, docid, 3, place, NULL FROM mo WHERE place <= 10)"""


@query(FILLED + " SELECT qid, docid, CAST(stage AS BIGINT) AS stage, place FROM al")
def neg_fused_filled(spark, d):
    """Exactly ten negatives of every query."""
    return _long(_fused_filled(spark, d), "stage", "place").select("qid", "docid", "stage", "place")


MEASURES = """, cq AS (SELECT qid, count(*) AS cand, sum(CASE WHEN support > 1 THEN 1 ELSE 0 END) AS ov2 FROM (SELECT f.* FROM f JOIN tx USING (docid) ANTI JOIN golds USING (qid, docid)) GROUP BY qid),
pq AS (SELECT qid, count(*) AS a, sum(CASE WHEN stage = 1 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN stage > 1 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN stage = 1 AND support > 1 THEN 1 ELSE 0 END) AS s FROM al GROUP BY qid),
jq AS (SELECT pq.*, coalesce(cand, 0) AS cand, coalesce(ov2, 0) AS ov2, f AS x FROM pq LEFT JOIN cq USING (qid)) SELECT count(*) AS rows, CAST(10 AS BIGINT) AS capacity_per_run, CAST(10 AS BIGINT) AS capacity_per_row, CAST(0 AS BIGINT) AS least_fallback,
round(avg(cand), 6) AS avg_candidates, round(avg(ov2), 6) AS avg_overlap_candidates, round(avg(a), 6) AS avg_selected, round(avg(r), 6) AS avg_run_negatives, round(avg(f), 6) AS avg_fallback, round(avg(x), 6) AS avg_excess_fallback,
""" + ", ".join(f"round(sum(CASE WHEN {c} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS {k}" for k, c in (("rows_with_run", "r > 0"), ("rows_with_overlap_candidates", "ov2 > 0"), ("rows_with_overlap_negatives", "s > 0"), ("rows_with_fallback", "f > 0"), ("rows_with_excess_fallback", "x > 0"), ("rows_only_fallback", "r = 0 AND f > 0"), ("rows_underfilled", "a < 10"))) + " FROM jq"


def _measured(spark, d, negatives, per_run=None):
    usable = fusion.reciprocal_rank_fusion(t.runs(spark, d)).join(t.keys(spark, d), "docid", "left_semi").join(t.golds(spark, d), ["qid", "docid"], "left_anti")
    b = quality.build_quality(negatives, 10, usable.select("qid", "docid", "support"), runs=12, per_run=per_run)
    whole = ("rows", "capacity_per_run", "capacity_per_row", "least_fallback")
    return b.select(*whole, *[F.round(c, 6).alias(c) for c in b.columns if c not in whole])


@query(FILLED + MEASURES)
def build_quality_filled(spark, d):
    """All measures of the filled set."""
    return _measured(spark, d, written(_fused_filled(spark, d), "filled"))


@query(f"""WITH {t.GOLDS}, {t.JUDGED}, docs AS (SELECT DISTINCT pubkey AS docid FROM collection_data), {RING.format(r="rg", src="docs")},
nd AS (SELECT j.qid, coalesce(n, 0) + 5 AS steps FROM judged j LEFT JOIN (SELECT qid, count(*) AS n FROM golds GROUP BY qid) USING (qid)), {drawn_sql("nd", "rg", "dr")}
SELECT qid, docid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY step) AS k FROM dr ANTI JOIN golds USING (qid, docid)) WHERE k <= 5""")
def neg_random(spark, d):
    return tr.random_negatives(t.judged(spark, d), t.keys(spark, d), t.golds(spark, d), 5)


@query(FUSED + ", al AS (SELECT * FROM w WHERE place <= 10)" + MEASURES)
def build_quality(spark, d):
    """All measures of the run candidates alone."""
    return _measured(spark, d, written(_fused(spark, d), "fused"))


@query("""WITH q AS (SELECT DISTINCT qid FROM en_train WHERE qid IS NOT NULL), r AS (SELECT qid, row_number() OVER (ORDER BY md5('42_' || qid), qid) AS r, count(*) OVER () AS n FROM q)
SELECT qid, CASE WHEN r <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN r <= CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'dev' ELSE 'test' END AS split FROM r""")
def split_by_query(spark, d):
    return tr.split_by_query(table(spark, d, "en_train"))


@query(f"""WITH {t.POSTS}, r AS (SELECT qid, 0 AS i, 'original' AS variant, {ws('text')} AS text FROM posts UNION ALL SELECT qid, 1, 'cleaned', {post_sql('')} FROM posts UNION ALL SELECT qid, 2, 'anonymous', {post_sql('@user')} FROM posts)
SELECT qid, arg_min(variant, i) AS variant, text FROM r WHERE text <> '' GROUP BY qid, text""")
def variant_rows(spark, d):
    """Original and cleaned texts of posts; equal texts of a query once."""
    p = t.posts(spark, d).select("qid", F.col("text").alias("original"), clean_post("text").alias("cleaned"), clean_post("text", "@user").alias("anonymous"))
    return tr.query_variants(p, ["original", "cleaned", "anonymous"])


PAIRS = CAND + """, ps AS (SELECT qid, docid FROM golds WHERE qid IN (SELECT qid FROM ng)),
pr AS (SELECT qid, docid, 1 AS label, 'pos' AS kind FROM ps UNION ALL SELECT qid, docid, 0, kind FROM ng UNION ALL SELECT qid, docid, 0, kind FROM ng WHERE kind = 'hard')"""


def _pairs(spark, d):
    neg = tr.offset_negatives(_cand(spark, d))
    pos = t.golds(spark, d).join(neg.select("qid").distinct(), "qid", "left_semi")
    return tr.labelled_pairs(pos, neg)


@query(PAIRS + " SELECT qid, docid, CAST(label AS BIGINT) AS label, kind FROM pr")
def pairs_oversample(spark, d):
    return _long(_pairs(spark, d), "label")


@query(PAIRS + " SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives, round(sum(1 - label) / CAST(greatest(sum(label), 1) AS DOUBLE), 6) AS pos_weight FROM pr")
def positive_weight(spark, d):
    return tr.positive_weight(_pairs(spark, d)).withColumn("pos_weight", F.round("pos_weight", 6))


PAIRS_ALL = CAND_ALL + PAIRS[len(CAND):]


def _pairs_all(spark, d):
    """Labelled pairs from the negatives of all runs together."""
    neg = written(tr.merged_negatives(tr.offset_negatives(_cand_all(spark, d), by=("system", "qid"))), "negatives")
    return tr.labelled_pairs(t.golds(spark, d).join(neg.select("qid").distinct(), "qid", "left_semi"), neg)


@query(PAIRS_ALL + """, a AS (SELECT qid, sum(label) AS p, sum(1 - label) AS n, count(*) AS c, count(DISTINCT docid) AS dd FROM pr GROUP BY qid)
, vk AS (SELECT qid, lower(regexp_replace(regexp_replace(title, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) AS k, count(DISTINCT docid) AS d, count(DISTINCT label) AS l, count(DISTINCT CASE WHEN label = 0 THEN docid END) AS dn FROM pr JOIN corpus USING (docid) WHERE trim(title) <> '' GROUP BY ALL)
SELECT qid, 'no positive' AS issue FROM a WHERE p = 0 UNION ALL SELECT qid, 'no negative' FROM a WHERE n = 0 UNION ALL SELECT qid, 'document twice' FROM a WHERE dd < c
UNION ALL SELECT DISTINCT qid, 'positive as negative' FROM (SELECT qid, docid FROM pr GROUP BY qid, docid HAVING count(DISTINCT label) > 1)
UNION ALL SELECT qid, 'short texts' FROM (SELECT qid, avg(coalesce(len(list_filter(regexp_split_to_array(title, '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+'), lambda x: x <> '')), 0)) AS m FROM pr LEFT JOIN corpus USING (docid) GROUP BY qid) WHERE m < 8
UNION ALL SELECT DISTINCT qid, 'no text' FROM pr LEFT JOIN corpus USING (docid) WHERE title IS NULL OR trim(title) = ''
UNION ALL SELECT DISTINCT qid, 'equal negatives' FROM vk WHERE dn > 1 UNION ALL SELECT DISTINCT qid, 'text of a positive' FROM vk WHERE l > 1 AND d > 1""")
def quality_violations(spark, d):
    texts = t.corpus(spark, d).select("docid", F.col("title").alias("text"))
    return quality.violations(_pairs_all(spark, d), texts, 8.0)


@query(CAND_ALL + " SELECT docid, count(*) AS uses FROM na GROUP BY docid ORDER BY uses DESC, docid LIMIT 10")
def negatives_reused(spark, d):
    """Over the negatives of every run."""
    return tr.reuse_of_negatives(tr.offset_negatives(_cand_all(spark, d), by=("system", "qid")))


@query(DENSE + """, p AS (SELECT qid, min(score) AS p FROM sc JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = docid AND a.label = b.label GROUP BY qid),
w AS (SELECT de.qid, docid, score, row_number() OVER (PARTITION BY de.qid ORDER BY rank) AS pos FROM de JOIN (SELECT qid, max(score) AS p FROM de GROUP BY qid) m ON m.qid = de.qid WHERE rank BETWEEN 3 AND 10 AND score <= 0.85 AND score <= p - CAST(0.05 AS DOUBLE))
SELECT qid, docid, round(score, 6) AS score, pos FROM w WHERE pos <= 3""")
def mining_window(spark, d):
    """Neighbours ranked 3 to 10, well below the best neighbour."""
    de = _dense_ranked(spark, d)
    best = de.groupBy("qid").agg(F.max("score").alias("score"))
    w = tr.mining_window(de, best, (3, 10), 0.85, 0.05, 3)
    return w.select("qid", "docid", F.round("score", 6).alias("score"), F.col("pos").cast("bigint").alias("pos"))


@query(f"""WITH {t.RUNS}, {t.GOLDS}, {t.CORPUS}, q AS (SELECT DISTINCT qid FROM en_eval), j AS (SELECT r.system, r.qid, r.docid, q.qid IS NOT NULL AS k, c.docid IS NOT NULL AS c, g.docid IS NOT NULL AS g FROM runs r LEFT JOIN q USING (qid) LEFT JOIN (SELECT DISTINCT docid FROM corpus) c ON c.docid = r.docid LEFT JOIN golds g ON g.qid = r.qid AND g.docid = r.docid)
SELECT system, count(DISTINCT qid) AS run_qids, count(DISTINCT CASE WHEN k THEN qid END) AS overlap_qids, count(DISTINCT CASE WHEN k AND c AND NOT g THEN qid END) AS usable_qids, count(*) AS entries, CAST(sum(CASE WHEN k AND c AND NOT g THEN 1 ELSE 0 END) AS BIGINT) AS usable,
CAST(sum(CASE WHEN k AND NOT c THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN k AND c AND g THEN 1 ELSE 0 END) AS BIGINT) AS positives, round(sum(CASE WHEN k AND c AND NOT g THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS usable_ratio FROM j GROUP BY system""")
def run_alignment(spark, d):
    a = quality.alignment(t.runs(spark, d), table(spark, d, "en_eval"), t.corpus(spark, d), t.golds(spark, d))
    return a.withColumn("usable_ratio", F.round("usable_ratio", 6))


@query("SELECT qid, count(DISTINCT pubkey) AS golds FROM en_train GROUP BY qid HAVING count(DISTINCT pubkey) > 1")
def several_golds(spark, d):
    return quality.one_gold(table(spark, d, "en_train"))


@query("SELECT qid, count(DISTINCT pubkey) AS golds FROM (SELECT text AS qid, pubkey FROM en_train UNION ALL SELECT text, pubkey FROM en_eval) GROUP BY qid HAVING count(DISTINCT pubkey) > 1")
def texts_with_several_golds(spark, d):
    """The same gate with the text as the query: equal posts that name different papers."""
    q = table(spark, d, "en_train").select("text", "pubkey").unionByName(table(spark, d, "en_eval").select("text", "pubkey"))
    return quality.one_gold(q, qid="text")


@query(PAIRS_ALL + """, o AS (SELECT qid, docid, max(label) AS label FROM pr GROUP BY qid, docid), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label DESC, docid) AS k FROM o)
SELECT qid, coalesce(string_agg(docid, ' ' ORDER BY k) FILTER (label > 0), '') AS pos, string_agg(docid, ' ' ORDER BY k) AS docs FROM k WHERE k <= 20 GROUP BY qid""")
def candidate_lists(spark, d):
    """Positives and documents of each query as lists of at most twenty."""
    c = tr.candidate_lists(_pairs_all(spark, d), 20)
    return c.select("qid", F.array_join("pos", " ").alias("pos"), F.array_join("docs", " ").alias("docs"))


@query(CAND_ALL + """, s AS (SELECT DISTINCT qid, docid, pos FROM na WHERE system = 'hybrid_513_b0001'), o AS (SELECT DISTINCT qid, docid, 1 AS y FROM runs WHERE system = 'bm25_v2_b0001' OR system = (SELECT min(system) FROM runs))
SELECT count(*) AS negatives, round(avg(pos), 6) AS mean_rank, count(y) AS overlap, round(count(y) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS overlap_rate FROM s LEFT JOIN o USING (qid, docid)""")
def negative_statistics(spark, d):
    """Mean place of one run's negatives, and how many of them the first run by name has too."""
    neg = tr.offset_negatives(_cand(spark, d)).select("qid", "docid", F.col("pos").alias("rank"))
    r = t.runs(spark, d)
    first = r.agg(F.min("system")).first()[0]
    s = tr.negative_statistics(neg, r.where(F.col("system").isin(first, "bm25_v2_b0001")))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_rank", "overlap_rate")})


@query("""WITH p AS (SELECT DISTINCT qid, pubkey AS docid FROM en_train WHERE qid IS NOT NULL AND pubkey IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY md5('42_' || qid || '_' || docid), qid, docid) AS r, count(*) OVER () AS n FROM p)
SELECT qid, docid, CASE WHEN r <= CAST(floor(n * 0.1) AS BIGINT) THEN 'dev' ELSE 'train' END AS split FROM r""")
def split_by_row(spark, d):
    """Rows, not queries, cut nine to one."""
    p = table(spark, d, "en_train").where("qid is not null and pubkey is not null").select("qid", F.col("pubkey").alias("docid")).distinct()
    return tr.split_rows(p, ["qid", "docid"])


@query(f"WITH {t.RUNS} SELECT qid AS index, '[' || string_agg(docid, ', ' ORDER BY rank) || ']' AS preds FROM runs WHERE system = 'hybrid_513_b0001' AND rank <= 5 GROUP BY qid")
def submission_rows(spark, d):
    return sinks.submission_rows(t.runs(spark, d).where("system = 'hybrid_513_b0001'"))


@query(f"WITH {t.CORPUS} SELECT docid, " + ", ".join(f"replace(replace(replace(coalesce({c}, ''), chr(9), ' '), chr(13), ' '), chr(10), ' ') AS {c}" for c in ("title", "abstract", "venue", "authors")) + " FROM corpus")
def corpus_export_rows(spark, d):
    return sinks.corpus_rows(t.corpus(spark, d), ["docid", "title", "abstract", "venue", "authors"])


@query("""WITH a AS (SELECT qid, row_number() OVER (ORDER BY md5('42_' || qid), qid) / CAST(count(*) OVER () AS DOUBLE) AS pl, md5('42_' || qid) AS h FROM (SELECT DISTINCT qid FROM en_train WHERE qid IS NOT NULL)),
b AS (SELECT qid, row_number() OVER (ORDER BY md5('42_' || qid), qid) / CAST(count(*) OVER () AS DOUBLE) AS pl, md5('42_' || qid) AS h FROM (SELECT DISTINCT qid FROM en_eval WHERE qid IS NOT NULL)),
u AS (SELECT *, row_number() OVER (ORDER BY pl, src, qid) AS r FROM (SELECT qid, 'a' AS src, pl, h FROM a UNION ALL SELECT qid, 'b', pl, h FROM b)), k AS (SELECT *, (r - 1) // 128 AS block FROM u)
SELECT qid, src, block * 128 + row_number() OVER (PARTITION BY block ORDER BY h, src) AS place FROM k""")
def interleaved_sets(spark, d):
    a = table(spark, d, "en_train").select("qid").where("qid is not null").distinct()
    b = table(spark, d, "en_eval").select("qid").where("qid is not null").distinct()
    return tr.interleaved(a, b, "qid")


@query("SELECT DISTINCT 'fr->en' AS direction, text AS source FROM final_fr_test WHERE trim(text) <> '' AND text NOT IN (SELECT text_original FROM final_fr_tradottoen_test WHERE text_original IS NOT NULL)")
def translation_cache_misses(spark, d):
    want = table(spark, d, "final_fr_test").select(F.lit("fr->en").alias("direction"), F.col("text").alias("source"))
    cache = table(spark, d, "final_fr_tradottoen_test").select(F.lit("fr->en").alias("direction"), F.col("text_original").alias("source"))
    return augmentation.cache_misses(want, cache)


BOTH = "SELECT text FROM en_train WHERE text IS NOT NULL UNION ALL SELECT text FROM en_eval WHERE text IS NOT NULL"


@query(f"""WITH p AS ({BOTH}), c AS (SELECT DISTINCT text, {post_sql('')} AS pv FROM p), n AS (SELECT text, pv, lower({ws('text')}) AS form FROM c WHERE trim(text) <> '')
SELECT DISTINCT a.text, b.text AS variant FROM n a JOIN n b USING (pv) WHERE a.form <> b.form""")
def back_translation_pairs(spark, d):
    """Variants of posts over a pivot: here the pivot is the cleaned post, which reposts in another dress share."""
    p = table(spark, d, "en_train").select("text").unionByName(table(spark, d, "en_eval").select("text")).where("text is not null and trim(text) <> ''")
    pivot = p.select(F.col("text").alias("source"), clean_post("text").alias("target")).distinct()
    return augmentation.back_translations(p, pivot, pivot.select(F.col("target").alias("source"), F.col("source").alias("target")))


GRID_W = [(0.5, 0.15, 0.35), (0.35, 0.15, 0.5), (0.45, 0.1, 0.45), (0.4, 0.2, 0.4), (0.5, 0.1, 0.4), (1.0, 0.0, 0.0)]
THREE = ["dense_m3_b0001", "sparse_m3_b0001", "colbert_m3_b0001"]


@query(f"""WITH {t.RUNS}, {t.GOLDS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM runs WHERE score IS NOT NULL AND system IN {tuple(THREE)} WINDOW w AS (PARTITION BY system, qid)),
x AS (SELECT qid, docid, {', '.join(f"sum(CASE WHEN system = '{s}' THEN CASE WHEN hi - lo > 1e-12 THEN (score - lo) / (hi - lo) ELSE 0 END ELSE 0 END) AS x{i}" for i, s in enumerate(THREE))} FROM m GROUP BY qid, docid),
g AS (SELECT * FROM (VALUES {', '.join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for i, (a, b, c) in enumerate(GRID_W))}) v(trial, w0, w1, w2)),
s AS (SELECT trial, qid, docid, round(x0 * w0 + x1 * w1 + x2 * w2, 9) AS score FROM x, g), r AS (SELECT *, row_number() OVER (PARTITION BY trial, qid ORDER BY score DESC, docid) AS rank FROM s),
h AS (SELECT trial, count(DISTINCT r.qid) AS hits FROM r JOIN golds USING (qid, docid) WHERE rank <= 10 GROUP BY trial), n AS (SELECT count(DISTINCT qid) AS n FROM runs WHERE system IN {tuple(THREE)} AND qid IN (SELECT qid FROM golds))
SELECT CAST(trial AS BIGINT) AS trial, w0, w1, w2, round(coalesce(hits, 0) / CAST(greatest(n, 1) AS DOUBLE), 6) AS recall, coalesce(hits, 0) AS hits FROM g LEFT JOIN h USING (trial), n""")
def fusion_weight_search(spark, d):
    w = augmentation.weight_search(t.runs(spark, d), t.golds(spark, d), THREE, GRID_W)
    return _long(w, "trial", "hits").withColumn("recall", F.round("recall", 6))


@query(PAIRS_ALL + f""", own AS (SELECT DISTINCT qid, docid FROM pr WHERE label = 0), hv AS (SELECT qid, count(DISTINCT CASE WHEN label = 0 THEN docid END) AS n, count(DISTINCT docid) AS held FROM pr GROUP BY qid),
po AS (SELECT docid FROM pr WHERE label = 1), {RING.format(r="rg", src="po")}, nd AS (SELECT qid, 12 - n + held AS steps FROM hv WHERE n < 12), {drawn_sql("nd", "rg", "dr")},
fi AS (SELECT qid, docid, step FROM dr ANTI JOIN pr USING (qid, docid)), bo AS (SELECT qid, docid, 'own' AS source, -1 AS step FROM own UNION ALL SELECT qid, docid, 'other', step FROM fi)
SELECT qid, docid, source FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source <> 'own', step, docid) AS k FROM bo) WHERE k <= 12 OR source = 'own'""")
def eval_groups_topped_up(spark, d):
    return augmentation.topped_up(_pairs_all(spark, d), 12)
