"""Streaming queries over the events.

In append mode a window is given out once the watermark, here ten minutes
behind the latest event, has passed its end. The SQL leaves the same windows out. It
holds for files in the order of their events; see ``brindle.streaming.run`` for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brindle.plans.registry import Plans
from brindle.sources import Tables
from brindle.streaming.run import FILES_PER_TRIGGER
from brindle.streaming import (
    hopping_counts,
    read_stream,
    run_append,
    run_complete,
    session_counts,
    tumbling_counts,
)

plans = Plans()


def _events(t: Tables) -> DataFrame:
    return read_stream(t.spark, t.folder, "events", "ts", "10 minutes", FILES_PER_TRIGGER)


@plans("""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type FROM events)
GROUP BY ALL
HAVING window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def stream_tumbling_append(t: Tables) -> DataFrame:
    return run_append(tumbling_counts(_events(t), "ts", "event_type", "1 hour"))


@plans("""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM (SELECT event_type,
             unnest([time_bucket(INTERVAL 30 MINUTE, ts),
                     time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])
               AS window_start
      FROM events)
GROUP BY ALL
HAVING window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def stream_hopping_append(t: Tables) -> DataFrame:
    return run_append(hopping_counts(_events(t), "ts", "event_type", "1 hour", "30 minutes"))


@plans("""
SELECT min(ts) AS window_start, max(ts) + INTERVAL 5 MINUTE AS window_end, user_id, count(*) AS n
FROM (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                  AS session
      FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                    + INTERVAL 5 MINUTE, true) AS starts
            FROM events))
GROUP BY user_id, session
HAVING window_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
""")
def stream_sessions_append(t: Tables) -> DataFrame:
    return run_append(session_counts(_events(t), "ts", "user_id", "5 minutes"))


@plans("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM events GROUP BY ALL
""")
def stream_tumbling_complete(t: Tables) -> DataFrame:
    return run_complete(tumbling_counts(_events(t), "ts", "event_type", "1 hour"))
