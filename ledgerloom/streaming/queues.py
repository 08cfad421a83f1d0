"""Streams over an event log. Every function takes a DataFrame that may be streaming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import folded


def deduplicated(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark: at-least-once delivery made idempotent."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def registry(events: DataFrame) -> DataFrame:
    """Running first and last time and count of each action."""
    return events.groupBy("action").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("uses"))


def tumbling(events: DataFrame, length: str, delay: str = "1 day") -> DataFrame:
    """Events of each window and action; late ones count until the watermark passes."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "action").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "action", "events")


def rate_limited(events: DataFrame, limit: int, seconds: int, delay: str = "1 day") -> DataFrame:
    """Whether each event is allowed: at most ``limit`` in a window that opens with a user's first event.

    A window is not aligned to the clock, so a user's events are folded in order. Streams keep (opening, count) as state until the
    watermark, ``delay`` behind the newest event, passes the window's end; batches fold sorted rows with one user's state at a time.
    """
    schema = "event_id long, user_id long, allowed boolean"

    def fold(part: pd.DataFrame, opened, count):
        part = part.sort_values(["ts", "event_id"])
        allowed = []
        for t in part["ts"].astype("datetime64[us]").astype("int64"):
            if opened is None or t >= opened + seconds * 1_000_000:
                opened, count = int(t), 0
            count += 1
            allowed.append(count <= limit)
        return pd.DataFrame({"event_id": part["event_id"], "user_id": part["user_id"], "allowed": allowed}), opened, count

    rows = events.select("event_id", "user_id", "ts")
    if not events.isStreaming:
        def step(state, row):
            user, event, micros = row
            if state[0] is None or micros >= state[0] + seconds * 1_000_000:
                state[:] = [micros, 0]
            state[1] += 1
            return ((event, user, state[1] <= limit),)

        timed = rows.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
        return folded(timed, ["user_id"], ["micros", "event_id"], lambda: [None, 0], step, schema)

    def stateful(key, parts, state):
        if state.hasTimedOut:
            # the window has passed: a user that comes back opens another
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        part = pd.concat(list(parts))
        out, opened, count = fold(part, opened, count)
        state.update((opened, count))
        state.setTimeoutTimestamp(max(opened // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield out

    late = rows.withWatermark("ts", delay)
    return late.groupBy("user_id").applyInPandasWithState(stateful, schema, "opened long, count int", "append", "EventTimeTimeout")


def recovered(events: DataFrame, minutes: int = 15, delay: str = "1 minute") -> DataFrame:
    """job_id, attempt and the time of every attempt given up: RUNNING, and neither DONE nor RUNNING again ``minutes`` later.

    ``events``: job_id, attempt, state and ts. In a stream an event-time timer per job fires when the watermark passes the end, which
    removes its state; a job that ends in time has none left. A batch looks at each event's next one.
    """
    rows = events.select("job_id", F.col("attempt").cast("long"), "state", "ts").where(F.col("state").isin("RUNNING", "DONE"))
    if not events.isStreaming:
        order = Window.partitionBy("job_id").orderBy("ts", "attempt", "state")
        end = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
        last = rows.agg(F.max("ts")).head()[0]
        due = rows.withColumn("next", F.coalesce(F.lead("ts").over(order), F.lit(last))).withColumn("given_up", end)
        return due.where("state = 'RUNNING' and next >= given_up").select("job_id", "attempt", "given_up")

    def stateful(key, parts, state):
        if state.hasTimedOut:
            attempt, due = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "attempt": [attempt], "given_up": pd.to_datetime([due], unit="us")})
            return
        found = []
        attempt, due = state.get if state.exists else (None, None)
        part = pd.concat(list(parts)).sort_values(["ts", "attempt", "state"])
        for number, kind, at in zip(part["attempt"], part["state"], part["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            if due is not None and at >= due:
                found.append((attempt, due))
            attempt, due = (int(number), int(at) + minutes * 60_000_000) if kind == "RUNNING" else (None, None)
        if due is None:
            if state.exists:
                state.remove()
        else:
            state.update((attempt, due))
            state.setTimeoutTimestamp(max(due // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]] * len(found), "attempt": [a for a, _ in found], "given_up": pd.to_datetime([d for _, d in found], unit="us")})

    return rows.withWatermark("ts", delay).groupBy("job_id").applyInPandasWithState(stateful, "job_id long, attempt long, given_up timestamp", "attempt long, due long", "append", "EventTimeTimeout")


#: A job's stages in order; one may be left out, none is entered twice or backwards.
STAGES = ("PARSING", "ANALYZING", "VERIFYING", "IMPORTING")


def stage_runs(log: DataFrame) -> DataFrame:
    """What each event of a job's log (job_id, event_id, ts, what, stage) ends: job_id, event_id, attempt, stage, status, micros.

    ENTER opens a later stage, if none is open; COMPLETE closes the open one; FAIL ends the attempt; RETRY starts the next one after a failure;
    FINISH ends the job, if no stage is open and one was entered, and stages before the last one that were never entered are SKIPPED.
    Rows: COMPLETED and FAILED stages with their time, SKIPPED ones, ILLEGAL for an event that its state doesn't allow and that changes nothing,
    RUNNING for the stage still open at the end (event_id null). Logs are folded in order of (ts, event_id), one job's state at a time.
    """
    number = {s: k for k, s in enumerate(STAGES)}

    def start():
        return {"attempt": 1, "open": None, "since": 0, "last": -1, "seen": 0, "end": None}

    def step(s, row):
        job, event, micros, what, stage = row
        out = lambda stage, status, spent=None: (job, event, s["attempt"], stage, status, spent)
        going = s["end"] is None
        if what == "ENTER" and going and s["open"] is None and number.get(stage, -1) > s["last"]:
            s |= {"open": stage, "since": micros, "last": number[stage], "seen": s["seen"] | 1 << number[stage]}
            return []
        if what == "COMPLETE" and going and s["open"] is not None:
            done, s["open"] = s["open"], None
            return [out(done, "COMPLETED", micros - s["since"])]
        if what == "FAIL" and going:
            done, s["open"], s["end"] = s["open"], None, "FAILED"
            return [out(done, "FAILED", micros - s["since"] if done else None)]
        if what == "RETRY" and s["end"] == "FAILED":
            s |= {**start(), "attempt": s["attempt"] + 1}
            return []
        if what == "FINISH" and going and s["open"] is None and s["last"] >= 0:
            s["end"] = "DONE"
            return [out(STAGES[k], "SKIPPED") for k in range(s["last"]) if not s["seen"] >> k & 1]
        return [out(None, "ILLEGAL")]

    def finish(key, s):
        return [(key[0], None, s["attempt"], s["open"], "RUNNING", None)] if s["open"] is not None else []

    rows = log.where("job_id is not null").select("job_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "what", "stage")
    return folded(rows, ["job_id"], ["micros", "event_id"], start, step, "job_id long, event_id long, attempt long, stage string, status string, micros long", finish)


def stage_timings(events: DataFrame) -> DataFrame:
    """Seconds that each user's events lasted until the next."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "action", F.timestamp_diff("MICROSECOND", F.col("ts"), F.lead("ts").over(order)).alias("micros"))


def claim(queue: DataFrame, now: str, limit: int) -> DataFrame:
    """The oldest due rows of a queue: pending, or running since over 15 minutes."""
    due = (F.col("state") == "PENDING") & (F.col("next_at") <= F.lit(now).cast("timestamp"))
    lost = (F.col("state") == "RUNNING") & (F.col("next_at") <= F.lit(now).cast("timestamp") - F.expr("interval 15 minutes"))
    return queue.where(due | lost).orderBy("next_at", "event_id").limit(limit)


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All available input in micro-batches; offsets are kept in the checkpoint, which takes the place of row locks."""
    query = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
