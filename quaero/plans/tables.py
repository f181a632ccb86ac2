"""Views of the tables that the queries share, as plans and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.functions.text import STOPWORDS, simple_tokens
from quaero.operators.fusion import normal_run
from quaero.session import table

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8199) || chr(8239) || chr(12288)"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """One row for each paper key; re-delivered rows are equal but for their load time, so that the key alone is compared."""
    return papers(spark, d).dropDuplicates(["docid"])


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row of the corpus."""
    return table(spark, d, "collection_data").select(F.col("pubkey").alias("docid"), "title", "abstract", "venue", "authors")


def keys(spark: SparkSession, d: str) -> DataFrame:
    """The paper keys alone."""
    return papers(spark, d).select("docid").distinct()


def topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shared_topics").select("qid", F.col("text").alias("query"))


def posts(spark: SparkSession, d: str) -> DataFrame:
    """Training posts with text, one row for each id."""
    return table(spark, d, "en_train").where("text is not null and qid is not null").select("qid", "text", "source").distinct()


def runs(spark: SparkSession, d: str) -> DataFrame:
    return normal_run(table(spark, d, "run_entries"))


def golds(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "en_train").select("qid", "pubkey")
    b = table(spark, d, "en_eval").select("qid", "pubkey")
    return a.unionByName(b).where("qid is not null and pubkey is not null").select("qid", F.col("pubkey").alias("docid")).distinct()


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Queries with a gold paper that some run answers."""
    return golds(spark, d).select("qid").distinct().join(table(spark, d, "run_entries").select("qid").distinct(), "qid", "left_semi")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(qid, system): every judged query with every run."""
    systems = table(spark, d, "run_entries").agg(F.array_sort(F.collect_set("run_name")).alias("s"))
    return judged(spark, d).crossJoin(F.broadcast(systems)).select("qid", F.explode("s").alias("system"))


def systems(spark: SparkSession, d: str) -> DataFrame:
    """(system): every run, one row each."""
    return table(spark, d, "run_entries").select(F.col("run_name").alias("system")).where("system is not null").distinct()


def fields() -> dict:
    return {"title": simple_tokens("title"), "abstract": simple_tokens("abstract")}


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(c: str) -> str:
    x = f"regexp_replace(regexp_replace(coalesce({c}, ''), 'https?://\\S+\\s?', '', 'g'), '@\\w+\\s?', '', 'g')"
    return f"list_filter(regexp_extract_all(lower(replace({x}, '#', '')), '[a-z0-9\\-]+'), lambda t: NOT list_contains({STOP_SQL}, t))"


CORPUS = "corpus AS (SELECT DISTINCT pubkey AS docid, title, abstract, venue, authors FROM collection_data)"
POSTS = "posts AS (SELECT DISTINCT qid, text, source FROM en_train WHERE text IS NOT NULL AND qid IS NOT NULL)"
RUNS = f"""re AS (SELECT run_name AS system, qid, nullif(trim(docid, {WS}), '') AS docid, CASE WHEN rank >= 1 THEN rank ELSE 2147483647 END AS r, CASE WHEN isnan(score) THEN NULL ELSE score END AS s FROM run_entries),
ro AS (SELECT system, qid, docid, min(r) AS r, max(s) AS score FROM re WHERE docid IS NOT NULL GROUP BY ALL),
runs AS (SELECT system, qid, docid, row_number() OVER (PARTITION BY system, qid ORDER BY r, score DESC NULLS LAST, docid) AS rank, score FROM ro)"""
GOLDS = "golds AS (SELECT DISTINCT qid, pubkey AS docid FROM (SELECT qid, pubkey FROM en_train UNION ALL SELECT qid, pubkey FROM en_eval) WHERE qid IS NOT NULL AND pubkey IS NOT NULL)"
JUDGED = "judged AS (SELECT DISTINCT qid FROM golds WHERE qid IN (SELECT qid FROM run_entries))"
GRID = "grid AS (SELECT qid, system FROM judged, (SELECT DISTINCT run_name AS system FROM run_entries))"
POSTINGS = f"""fd AS (SELECT docid, 'title' AS field, {tokens_sql('title')} AS tk FROM corpus UNION ALL SELECT docid, 'abstract', {tokens_sql('abstract')} FROM corpus),
st AS (SELECT field, count(*) AS n, avg(len(tk)) AS avgdl FROM fd GROUP BY field),
po AS (SELECT field, docid, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, docid, len(tk) AS dl, unnest(tk) AS term FROM fd) GROUP BY field, docid, term),
dfs AS (SELECT field, term, count(*) AS df FROM po GROUP BY field, term)"""


def bm25_sql(terms: str, out: str = "sc", title: float = 1.0) -> str:
    """CTE of scores for a CTE (qid, term, qtf, weight)."""
    return f"""{out} AS (SELECT qid, docid, round(sum(weight * qtf * CASE WHEN field = 'title' THEN CAST({title} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END
  * ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 9) AS score
  FROM {terms} JOIN po USING (term) JOIN dfs USING (field, term) JOIN st USING (field) GROUP BY qid, docid)"""


def ranked_sql(src: str, out: str, k: int) -> str:
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {src}) WHERE rank <= {k})"


TOPIC_TERMS = f"qt AS (SELECT qid, term, count(*) AS qtf, CAST(1 AS DOUBLE) AS weight FROM (SELECT qid, unnest({tokens_sql('text')}) AS term FROM shared_topics) GROUP BY qid, term)"
