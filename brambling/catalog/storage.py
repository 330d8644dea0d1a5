"""Materialised bitmaps, statistics of keys, and counts kept from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings
from ..sources.tables import describe_keys, shared_folder
from ..streaming import maintained
from .registry import Tables, query


def _postings(t: Tables):
    return postings.posting_table(t.events.withColumn("u", F.nullif(F.col("user_id") % 7, F.lit(0))), ["event_type", "u"], "event_id")


@query("posting_and", "SELECT count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND nullif(user_id % 7, 0) = 3")
def posting_and(t: Tables):
    return postings.count_and(_postings(t), {"event_type": ["click", "view"], "u": [3]})


@query("posting_and_not", "SELECT count(*) AS n FROM events WHERE event_type = 'click' AND nullif(user_id % 7, 0) IS DISTINCT FROM 3")
def posting_and_not(t: Tables):
    return postings.count_and_not(_postings(t), "event_type", ["click"], "u", [3])


@query("key_summary", "SELECT 'event_type' AS \"column\", event_type AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'u', CAST(nullif(user_id % 7, 0) AS varchar), count(*) FROM events GROUP BY ALL")
def key_summary(t: Tables):
    return postings.key_summary(_postings(t))


@query("key_statistics", "SELECT count(*) AS n_rows, count(*) - count(g) AS n_null, CAST(0 AS bigint) AS n_empty, count(g) AS n_entries, count(DISTINCT g) AS n_distinct, (SELECT max(c) FROM (SELECT count(*) AS c FROM events WHERE nullif(user_id % 7, 0) IS NOT NULL GROUP BY nullif(user_id % 7, 0))) AS n_largest FROM (SELECT nullif(user_id % 7, 0) AS g FROM events)")
def key_statistics(t: Tables):
    return describe_keys(t.events.withColumn("g", F.nullif(F.col("user_id") % 7, F.lit(0))), "g")


@query("streamed_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streamed_counts(t: Tables):
    folder = shared_folder(t.spark, "stream")
    # A file stream reads a folder, so the one file is named by a glob of its folder.
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    maintained.maintain_counts(stream, ["event_type"], f"{folder}/deltas", f"{folder}/checkpoint").awaitTermination()
    return maintained.current_counts(t.spark, f"{folder}/deltas", ["event_type"])
