"""The additional event query: the plan that a stream would run, over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaero.session import table
from quaero.streaming.serving import windowed_counts

SQL = {"events_windowed": "SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}


def events_windowed(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


Q = {"events_windowed": events_windowed}
