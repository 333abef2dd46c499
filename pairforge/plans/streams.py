"""Streams over the events table, each with its batch twin in SQL (extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.registry import CORE, table
from pairforge.session import work_dir
from pairforge.streaming import events as ev

PARTS = 4
#: The files of the stored table come in no order, so the watermark spans all of it and the result is the batch's.
LATE = "1000 days"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events in the order of their time, as several files, so that state is carried over micro-batches."""
    path = f"{work_dir(spark)}/events"
    rows = table(spark, sf, "events")
    rows.repartitionByRange(PARTS, "ts").sortWithinPartitions("ts").write.parquet(path)
    return ev.read_stream(spark, path, rows.schema)


@CORE.query("stream_tumbling", "S13", oracle="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run(ev.tumbling(_stream(spark, sf), late=LATE), "complete")


@CORE.query(
    "stream_sliding", "S13",
    oracle="SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS start FROM events) GROUP BY 1",
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run(ev.sliding(_stream(spark, sf), late=LATE), "complete")


@CORE.query(
    "stream_session", "S13",
    oracle="""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS first FROM events
    ), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run(ev.session(_stream(spark, sf), late=LATE), "complete")


@CORE.query("stream_dedup", "S13", oracle="SELECT DISTINCT event_id FROM events")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ev.run(ev.deduplicated(_stream(spark, sf), "event_id", late=LATE).select("event_id"), "append")


@CORE.query("stream_state_fold", "V16", "S13", oracle="SELECT user_id, count(*) AS n, CAST(sum(round(value * 100)) AS BIGINT) AS cents FROM events GROUP BY 1")
def stream_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    # Totals only grow, so each user's last state is the largest.
    return ev.run(ev.folded(_stream(spark, sf)), "update").groupBy("user_id").agg(F.max_by(F.struct("n", "cents"), "n").alias("x")).select("user_id", "x.n", "x.cents")


@CORE.query(
    "stream_late", "S13",
    oracle="""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT start, event_type, n FROM w, m WHERE start + INTERVAL 1 HOUR <= mark""",
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Files in the order of time and, at last, a copy of the first one: its rows are later than the watermark of a day and
    are dropped, and windows are given once, when the watermark has passed them.
    """
    path, rows = f"{work_dir(spark)}/events", table(spark, sf, "events")
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * i / PARTS for i in range(1, PARTS)]
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("ts") >= F.lit(c)).cast("int")
    parts = [rows.filter(number == i) for i in range(PARTS)]
    for part in [*parts, parts[0]]:  # one after the other, as files are taken in the order of their times
        part.coalesce(1).write.mode("append").parquet(path)
    return ev.run(ev.tumbling(ev.read_stream(spark, path, rows.schema), late=ev.LATE), "append")
