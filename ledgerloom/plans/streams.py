"""Queries of the streaming operators, over the whole event table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..sources import views as V
from ..streaming import queues as Q


def q1(b):
    queue = b.events.select("event_id", F.when(F.col("k") < 30, "PENDING").when(F.col("k") < 35, "RUNNING").otherwise("DONE").alias("state"), F.col("ts").alias("next_at"))
    return Q.claim(queue, "2024-01-10 00:00:00", 100).select("event_id", "state")


def q2(b):
    return Q.deduplicated(b.events.select("user_id", "action", F.to_date("ts").alias("d"), "ts"), ["user_id", "action", "d"]).groupBy("user_id").agg(F.count("*").alias("events"))


def q5(b):
    return Q.rate_limited(b.events, 3, 6 * 3600)


def q6(b):
    return Q.registry(b.events).select("action", dates.epoch(F.col("first_at")).alias("first_us"), dates.epoch(F.col("last_at")).alias("last_us"), "uses")


def q7(b):
    return Q.stage_timings(b.events)


def q7_runs(b):
    """A user's events as the log of one job: what happens and to which stage by the event's number and value."""
    what = F.get(F.array(*map(F.lit, ["ENTER", "COMPLETE", "ENTER", "FINISH", "COMPLETE", "FAIL", "RETRY", "ENTER"])), (F.col("event_id") % 8).cast("int"))
    stage = F.get(F.array(*map(F.lit, Q.STAGES)), F.col("k") % 4)
    log = b.events.select(F.col("user_id").alias("job_id"), "event_id", "ts", what.alias("what"), F.when(what == "ENTER", stage).alias("stage"))
    return Q.stage_runs(log)


Q7_SQL = f"""WITH RECURSIVE {V.EVENTS}, o AS (SELECT user_id AS job_id, event_id, epoch_us(ts) AS t, ['ENTER', 'COMPLETE', 'ENTER', 'FINISH', 'COMPLETE', 'FAIL', 'RETRY', 'ENTER'][event_id % 8 + 1] AS what, k % 4 AS stage, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ev),
f AS (SELECT job_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS event_id, 1 AS attempt, -1 AS open, CAST(0 AS BIGINT) AS since, -1 AS last, 0 AS seen, 'GOING' AS state, 'NONE' AS did, -1 AS closed, CAST(NULL AS BIGINT) AS spent FROM o WHERE r = 1
  UNION ALL SELECT n.job_id, n.r, n.event_id, CASE WHEN did = 'RETRY' THEN attempt + 1 ELSE attempt END, CASE did WHEN 'ENTER' THEN stage WHEN 'COMPLETE' THEN -1 WHEN 'FAIL' THEN -1 WHEN 'RETRY' THEN -1 ELSE open END, CASE WHEN did = 'ENTER' THEN t ELSE since END,
    CASE did WHEN 'ENTER' THEN stage WHEN 'RETRY' THEN -1 ELSE last END, CASE did WHEN 'ENTER' THEN seen | (1 << stage) WHEN 'RETRY' THEN 0 ELSE seen END, CASE did WHEN 'FAIL' THEN 'FAILED' WHEN 'RETRY' THEN 'GOING' WHEN 'FINISH' THEN 'DONE' ELSE state END, did, open, CASE WHEN did IN ('COMPLETE', 'FAIL') AND open >= 0 THEN t - since END
  FROM (SELECT o.job_id, o.r, o.event_id, o.t, CAST(o.stage AS INT) AS stage, f.attempt, f.open, f.since, f.last, f.seen, f.state,
      CASE WHEN what = 'ENTER' AND state = 'GOING' AND open < 0 AND o.stage > last THEN what WHEN what = 'COMPLETE' AND state = 'GOING' AND open >= 0 THEN what WHEN what = 'FAIL' AND state = 'GOING' THEN what WHEN what = 'RETRY' AND state = 'FAILED' THEN what
        WHEN what = 'FINISH' AND state = 'GOING' AND open < 0 AND last >= 0 THEN what ELSE 'ILLEGAL' END AS did
    FROM f JOIN o ON o.job_id = f.job_id AND o.r = f.r + 1) n),
names AS (SELECT ['PARSING', 'ANALYZING', 'VERIFYING', 'IMPORTING'] AS s)
SELECT job_id, event_id, CAST(attempt AS BIGINT) AS attempt, CASE WHEN closed >= 0 AND did <> 'ILLEGAL' THEN s[closed + 1] END AS stage, CASE did WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAIL' THEN 'FAILED' ELSE did END AS status, spent AS micros FROM f, names WHERE did IN ('COMPLETE', 'FAIL', 'ILLEGAL')
UNION ALL SELECT job_id, event_id, attempt, s[i + 1], 'SKIPPED', NULL FROM (SELECT f.*, unnest(range(last)) AS i FROM f WHERE did = 'FINISH') x, names WHERE (seen >> CAST(i AS INT)) & 1 = 0
UNION ALL SELECT job_id, NULL, attempt, s[open + 1], 'RUNNING', NULL FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY r DESC) AS back FROM f) x, names WHERE back = 1 AND open >= 0"""


def q4(b):
    """Attempts of jobs (a user's errors and clicks run, views end) that nothing followed for 15 hours."""
    state = F.when(F.col("action").isin("click", "error"), "RUNNING").when(F.col("action") == "view", "DONE").otherwise("OTHER")
    jobs = b.events.select(F.col("user_id").alias("job_id"), F.col("k").alias("attempt"), state.alias("state"), "ts")
    return Q.recovered(jobs, 15 * 60).withColumn("given_up", dates.epoch(F.col("given_up")))


def windows(b):
    return Q.tumbling(b.events, "6 hours").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


Q5_SQL = f"""WITH RECURSIVE {V.EVENTS}, o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ev),
f AS (SELECT event_id, user_id, r, t AS opened, 1 AS n FROM o WHERE r = 1
  UNION ALL SELECT o.event_id, o.user_id, o.r, CASE WHEN t >= opened + 21600000000 THEN t ELSE opened END, CASE WHEN t >= opened + 21600000000 THEN 1 ELSE n + 1 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT event_id, user_id, n <= 3 AS allowed FROM f"""
QUERIES = {
    "Q1_Q4_claim": (q1, f"WITH {V.EVENTS}, q AS (SELECT event_id, CASE WHEN k < 30 THEN 'PENDING' WHEN k < 35 THEN 'RUNNING' ELSE 'DONE' END AS state, ts FROM ev) SELECT event_id, state FROM q WHERE (state = 'PENDING' AND ts <= TIMESTAMP '2024-01-10') OR (state = 'RUNNING' AND ts <= TIMESTAMP '2024-01-10' - INTERVAL 15 MINUTE) ORDER BY ts, event_id LIMIT 100"),
    "Q2_idempotent": (q2, f"WITH {V.EVENTS} SELECT user_id, count(DISTINCT (action, CAST(ts AS DATE))) AS events FROM ev GROUP BY 1"),
    "Q5_rate_limit": (q5, Q5_SQL),
    "Q6_registry_merge": (q6, f"WITH {V.EVENTS} SELECT action, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS uses FROM ev GROUP BY 1"),
    "Q4_recovered_attempts": (q4, f"WITH {V.EVENTS}, s AS (SELECT user_id AS job_id, k, ts, CASE WHEN action = 'view' THEN 'DONE' ELSE 'RUNNING' END AS state FROM ev WHERE action IN ('click', 'error', 'view')), n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, k, state), (SELECT max(ts) FROM s)) AS next FROM s) SELECT job_id, CAST(k AS BIGINT) AS attempt, epoch_us(ts) + 54000000000 AS given_up FROM n WHERE state = 'RUNNING' AND epoch_us(next) >= epoch_us(ts) + 54000000000"),
    "Q7_stage_runs": (q7_runs, Q7_SQL),
    "Q7_stage_timings": (q7, f"WITH {V.EVENTS} SELECT event_id, action, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM ev"),
    "Q_tumbling_windows": (windows, f"WITH {V.EVENTS} SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS start, action, count(*) AS events FROM ev GROUP BY 1, 2"),
}
