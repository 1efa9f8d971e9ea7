"""Streams drained with availableNow, against batch SQL: windows that the final watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.plans.track_queries import rnd, rounded
from trackspark.streaming import streams as S

QUERIES: dict = {
    "s4_tumbling": lambda spark, d: S.run_to_table(S.tumbling_counts(S.events_stream(spark, d))).select("start", "event_type", "n", rounded("mean", 4).alias("mean")),
    "s6_sessions": lambda spark, d: S.run_to_table(S.sessions(S.events_stream(spark, d))),
    "s8_sliding": lambda spark, d: S.run_to_table(S.sliding_counts(S.events_stream(spark, d))),
    "s3_deduplicated": lambda spark, d: S.run_to_table(S.deduplicated(S.events_stream(spark, d))).select("event_id", "user_id"),
    "s1_stream_table": lambda spark, d: S.run_to_table(S.events_stream(spark, d)).groupBy("event_type").agg(F.count("*").alias("n")),
}

ORACLE_SQL: dict = {
    "s4_tumbling": "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, " + rnd("avg(value)", 4) + """ as mean from events group by 1, 2
having time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select max(ts) - interval '10 minutes' from events)""",
    "s6_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '24 hours' then 0 else 1 end as new from events
), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select min(ts) as start, max(ts) + interval '24 hours' as "end", user_id, count(*) as n from s group by user_id, k having max(ts) + interval '24 hours' <= (select max(ts) - interval '1 hour' from events)""",
    "s8_sliding": """select start, event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '1 hour', ts) - i * interval '1 hour' for i in range(6)]) as start from events) group by 1, 2
having start + interval '6 hours' <= (select max(ts) - interval '10 minutes' from events)""",
    "s3_deduplicated": "select distinct event_id, user_id from events",
    "s1_stream_table": "select event_type, count(*) as n from events group by 1",
}
