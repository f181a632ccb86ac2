"""Queries that arrive as a stream, scored against written postings; and windowed counts of events.

Additional: the batch engine does not need streams. State is bounded by
watermarks; each micro-batch of queries runs the batch plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaero.operators import index


def score_stream(queries: DataFrame, posts: DataFrame, statistics: DataFrame, tokens: Column, out: str, checkpoint: str, k: int = 10) -> StreamingQuery:
    """Appends (qid, docid, score, rank) of each micro-batch of (qid, query) to a parquet folder; a replayed batch overwrites its own part."""

    def one(batch: DataFrame, epoch: int) -> None:
        hits = index.ranked(index.bm25_scores(index.query_terms(batch, "qid", tokens), posts, statistics), k)
        hits.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, key, n, total) of tumbling windows; works on streams and tables."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    g = w.groupBy(F.window(time, width).alias("w"), F.col(by).alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "key", "n", "total")


def query_files(spark: SparkSession, folder: str) -> DataFrame:
    """(qid, query) of JSON-lines files that appear in a folder."""
    return spark.readStream.schema("qid string, query string").json(folder)
