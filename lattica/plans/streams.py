"""Streaming queries over `events`, run to the end of what is available; their SQL is the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import operators as s
from . import register

query = register("streams")


def events(spark, sf_dir) -> DataFrame:
    """Watermarks need TIMESTAMP; events.ts has none of its time zone, and is taken as UTC."""
    e = s.parquet_stream(spark, f"{sf_dir}/events.parquet")
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
    return e.withColumn("micros", micros).withColumn("ts", F.timestamp_micros("micros"))


def micros(c: str):
    return F.unix_micros(c)


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    t = s.tumbling_counts(events(spark, sf_dir), "ts", "1 hour", "10 minutes", ["event_type"], "value")
    out = spark.read.parquet(s.run_available(t, "tumbling", "complete"))
    return out.select(micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM n GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    t = s.sessions(events(spark, sf_dir), "ts", "6 hours", "1 day", "user_id")
    out = spark.read.parquet(s.run_available(t, "sessions", "complete"))
    return out.select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_distinct(spark, sf_dir):
    t = s.distinct_events(events(spark, sf_dir), "ts", "60 days", ["user_id", "event_type"]).select("user_id", "event_type")
    return spark.read.parquet(s.run_available(t, "distinct")).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id, epoch_us(ts)::DOUBLE AS end_order, row_number() OVER o AS rn, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS total FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, rn - 8 AS window_no, end_order, round(total, 4) AS total FROM w WHERE rn >= 8""")
def stream_windows(spark, sf_dir):
    """Windows of eight rows from a stream with state equal those of the batch operator."""
    t = s.count_windows(events(spark, sf_dir), "user_id", ["micros", "event_id"], ["value"], 8)
    return spark.read.parquet(s.run_available(t, "windows")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, min(epoch_us(ts)) AS first_us, count(*) AS n_contacts FROM events GROUP BY 1")
def stream_first_touch(spark, sf_dir):
    return s.first_touch(spark, events(spark, sf_dir), "user_id", "micros", "touch").withColumnRenamed("first_time", "first_us")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_chunked_scan(spark, sf_dir):
    """A scan in micro-batches, each counted and appended; the parts are added up."""
    e = s.parquet_stream(spark, f"{sf_dir}/events.parquet", 1)
    out = f"{s.shared_dir(spark)}/chunks-{spark.sparkContext.startTime}-{id(e)}"
    s.run_available(e, "chunks", each=lambda df, i: df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={i}"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))
