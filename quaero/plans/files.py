"""Queries that write the tables as files of the exchange formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.plans import tables as t
from quaero.session import shared_path, table
from quaero.sources import readers, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RUN = "hybrid_513_b0001"


def _run(spark, d):
    return t.runs(spark, d).where(F.col("system") == RUN)


def _out(df):
    return df.select("system", "qid", "docid", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {t.RUNS} SELECT '{RUN}' AS system, qid, docid, rank FROM runs WHERE system = '{RUN}' AND rank <= 100 AND qid IS NOT NULL")
def file_run_map(spark, d):
    """A run as JSON maps from queries to lists."""
    path = shared_path(spark, "run-map")
    sinks.write_rankings_json(_run(spark, d).where("qid is not null"), path, most=100)
    return _out(readers.ranking_map(spark, path, RUN, lines=True))


@query(f"WITH {t.RUNS} SELECT '{RUN}' AS system, qid, docid, rank, score FROM runs WHERE system = '{RUN}' AND qid IS NOT NULL")
def file_run_records(spark, d):
    """A run as one JSON record for each entry."""
    path = shared_path(spark, "run-records")
    _run(spark, d).where("qid is not null").select(F.col("qid").alias("query_id"), F.col("docid").alias("document_id"), "rank", F.col("score").alias("similarity")).write.json(path)
    r = readers.run_records(spark, path, RUN)
    return r.select("system", "qid", "docid", F.col("rank").cast("bigint").alias("rank"), "score")


@query(f"WITH {t.RUNS} SELECT '{RUN}' AS system, qid, docid, rank FROM runs WHERE system = '{RUN}' AND qid IS NOT NULL")
def file_run_trec(spark, d):
    """A run as lines of six columns."""
    path = shared_path(spark, "run-trec")
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "docid", "rank", F.coalesce(F.col("score"), F.lit(0.0)), F.lit("tag"))
    _run(spark, d).where("qid is not null").select(line.alias("value")).write.text(path)
    return _out(readers.trec_run(spark, path, RUN))


@query(r"""SELECT DISTINCT qid, regexp_replace(text, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g') AS query, pubkey AS gold FROM en_eval WHERE qid IS NOT NULL AND regexp_matches(text, '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]')""")
def file_queries(spark, d):
    """Queries as JSON lines; records without a text are left out."""
    path = shared_path(spark, "queries")
    table(spark, d, "en_eval").select(F.col("qid").alias("index"), "text", "pubkey", F.col("split").alias("extra")).distinct().write.json(path)
    return readers.queries(spark, path, lines=True).select("qid", "query", "gold")


@query("SELECT DISTINCT pubkey AS docid, title, venue FROM collection_data")
def file_papers(spark, d):
    """Papers as JSON lines under the other id name."""
    path = shared_path(spark, "papers")
    table(spark, d, "collection_data").select(F.col("pubkey").alias("cord_uid"), "title", "abstract", "venue", "authors").write.json(path)
    return readers.papers(spark, path, lines=True).select("docid", "title", "venue").distinct()


@query("""SELECT CASE WHEN qid IS NULL THEN 'no query id' WHEN docid IS NULL OR trim(docid, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8199) || chr(8239) || chr(12288)) = '' THEN 'no document id' ELSE 'kept' END AS reason, count(*) AS rows FROM run_entries GROUP BY 1""")
def file_record_issues(spark, d):
    """Entries that a reader of records skips, by reason."""
    path = shared_path(spark, "entries")
    table(spark, d, "run_entries").select("qid", "docid").write.json(path)
    return readers.record_issues(spark, path)


@query("SELECT DISTINCT qid, pubkey AS docid, CAST(1 AS BIGINT) AS relevance FROM en_eval WHERE qid IS NOT NULL AND pubkey IS NOT NULL")
def file_qrels(spark, d):
    """Judgements as JSON maps, an object on each line."""
    path = shared_path(spark, "qrels")
    e = table(spark, d, "en_eval").where("qid is not null and pubkey is not null").select("qid", "pubkey").distinct()
    e.select(F.to_json(F.create_map("qid", F.create_map("pubkey", F.lit(1)))).alias("value")).write.text(path)
    return readers.qrels(spark, path, lines=True).select("qid", "docid", F.col("relevance").cast("bigint").alias("relevance"))


@query("SELECT DISTINCT pubkey AS gold, qid FROM en_eval WHERE qid IS NOT NULL AND pubkey IS NOT NULL")
def file_ground_truth(spark, d):
    """Judged posts as tab-separated rows with a header."""
    path = shared_path(spark, "truth")
    e = table(spark, d, "en_eval").where("qid is not null and pubkey is not null").select(F.col("qid").alias("post_id"), F.regexp_replace("text", r"[\t\r\n\"\\\\]", " ").alias("tweet_text"), F.col("pubkey").alias("cord_uid")).distinct()
    e.write.csv(path, sep="\t", header=True)
    return readers.ground_truth_tsv(spark, path).select("gold", "qid").distinct()
