"""Search, platform statistics, audit activity and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, number: int = 0, size: int = 20) -> DataFrame:
    """One page in a total order; pages start at 0, sizes are held within 1 to 100."""
    size = min(max(size, 1), 100)
    return df.orderBy(*order).offset(max(number, 0) * size).limit(size)


def ledger_search(ledger: DataFrame, accounts: DataFrame | None = None, keyword: str | None = None, **where) -> DataFrame:
    """Rows that pass every filter given: account_id, category, txn_type, date_from, date_to, amount_from, amount_to.

    keyword: part of the description or merchant in any case, or of the account's name.
    Filters that are None are left out, so what remains reaches the scan.
    """
    tests = [F.col(c) == where[c] for c in ("account_id", "category", "txn_type", "user_id") if where.get(c) is not None]
    for c, low, high in (("txn_date", "date_from", "date_to"), ("amount", "amount_from", "amount_to")):
        tests += [F.col(c) >= where[low]] if where.get(low) is not None else []
        tests += [F.col(c) <= where[high]] if where.get(high) is not None else []
    rows = ledger.where(reduce(lambda a, b: a & b, tests)) if tests else ledger
    if keyword is None:
        return rows
    low = keyword.lower()
    hit = F.contains(F.lower("description"), F.lit(low)) | F.contains(F.lower("merchant"), F.lit(low))
    if accounts is None:
        return rows.where(hit)
    named = accounts.where(F.contains(F.lower("name"), F.lit(low))).select("account_id").distinct().withColumn("named", F.lit(True))
    return rows.join(named, "account_id", "left").where(hit | F.coalesce("named", F.lit(False))).drop("named")


def sorted_ledger(df: DataFrame, field: str = "date", descending: bool = True) -> list[Column]:
    """Order by date or amount (anything else: date), ties by id."""
    c = F.col({"date": "txn_date", "amount": "amount"}.get(field, "txn_date"))
    return [c.desc() if descending else c.asc(), F.col("txn_id").asc()]


def status_counts(ledger: DataFrame) -> DataFrame:
    """One row: rows of each reconciliation status and recurring rows."""
    n = lambda c: F.count(F.when(c, 1))
    return ledger.agg(*[n(F.col("status") == s).alias(s.lower()) for s in ("OK", "DUPLICATE", "TRANSFER", "REFUND")], n(F.col("is_recurring")).alias("recurring"))


def platform_spend(ledger: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Top labels of all users by raw expense."""
    return ledger.where("txn_type = 'EXPENSE'").groupBy(key).agg(F.count("*").alias("rows"), F.sum("amount").alias("spent")).orderBy(F.desc("spent"), key).limit(n)


def catalog(ledger: DataFrame) -> DataFrame:
    """Merchants with their users and rows."""
    return ledger.groupBy("merchant").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("rows"))


def inactive_users(users: DataFrame, audit: DataFrame) -> DataFrame:
    """users.user_id NOT IN (active ids): as in SQL, one null id among the active leaves nothing."""
    active = audit.select("user_id").distinct()
    return users.sparkSession.sql("select user_id from {users} where user_id not in (select user_id from {active})", users=users, active=active)


def inactive_users_ignoring_nulls(users: DataFrame, audit: DataFrame) -> DataFrame:
    return users.join(audit.select("user_id").distinct(), "user_id", "left_anti").select("user_id")


def daily_activity(events: DataFrame, last_day: str, days: int = 7, zone_hours: float = 5.5, closed: bool = True) -> DataFrame:
    """Events, users and errors of each local day up to ``last_day``, zeros included.

    closed: both ends of a day count, so an event at midnight is in two days.
    """
    spark = events.sparkSession
    spine = spark.range(days).select(F.date_sub(F.lit(last_day).cast("date"), F.col("id").cast("int")).alias("day"))
    shift = F.make_interval(hours=F.lit(int(zone_hours)), mins=F.lit(int(zone_hours % 1 * 60)))
    local = events.withColumn("local", F.col("ts") + shift)
    day = F.to_date("local")
    midnight = F.col("local") == F.date_trunc("day", "local")
    spread = local.withColumn("day", F.explode(F.when(midnight & F.lit(closed), F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))))
    counts = spread.groupBy("day").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count(F.when(F.col("action") == "error", 1)).alias("errors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return F.broadcast(spine).join(counts, "day", "left").select("day", zero("events"), zero("users"), zero("errors"))


def overview(events: DataFrame, day: str) -> DataFrame:
    """One row: the day's events, users and actions and their change on the day before, in one pass."""
    on = F.to_date("ts") == F.lit(day).cast("date")
    before = F.to_date("ts") == F.date_sub(F.lit(day).cast("date"), 1)
    n = lambda c: F.count(F.when(c, 1))
    sums = events.where(on | before).agg(n(on).alias("events"), n(before).alias("events_before"), F.count_distinct(F.when(on, F.col("user_id"))).alias("users"), F.count_distinct(F.when(before, F.col("user_id"))).alias("users_before"), n(on & (F.col("action") == "purchase")).alias("purchases"), n(on & (F.col("action") == "error")).alias("errors"))
    return sums.withColumn("events_delta", F.col("events") - F.col("events_before")).withColumn("users_delta", F.col("users") - F.col("users_before"))


def funnel(users: DataFrame, events: DataFrame) -> DataFrame:
    """Users, and distinct users that ever did each step, removed rows included."""
    steps = events.where(F.col("action").isin("signup", "view", "purchase")).groupBy(F.col("action").alias("step")).agg(F.count_distinct("user_id").alias("users"))
    return users.agg(F.lit("all").alias("step"), F.count("*").alias("users")).unionByName(steps)


def workspace(ledger: DataFrame) -> DataFrame:
    """Each user's rows, automation rate in percent and rows to review."""
    total, manual = F.count("*"), F.count(F.when(F.col("decision_source") == "MANUAL", 1))
    sums = ledger.groupBy("user_id").agg(total.alias("rows"), manual.alias("manual"), F.count(F.when(F.col("needs_review"), 1)).alias("to_review"), F.count(F.when(F.col("status") == "DUPLICATE", 1)).alias("duplicates"))
    return sums.withColumn("automation", F.floor((F.col("rows") - F.col("manual")) * 10000 / F.col("rows") + 0.5) / 100)


def milestones(events: DataFrame) -> DataFrame:
    """Each user's first time of each step, one row a step."""
    first = lambda a: F.min(F.when(F.col("action") == a, F.col("ts")))
    wide = events.groupBy("user_id").agg(first("signup").alias("signup"), first("view").alias("view"), first("purchase").alias("purchase"))
    return wide.unpivot("user_id", ["signup", "view", "purchase"], "step", "first_at")


def hits(*parts: DataFrame) -> DataFrame:
    """Search hits of several kinds, each limited on its own."""
    return reduce(DataFrame.unionByName, parts)


def goal_progress(contributions: DataFrame, target: float) -> DataFrame:
    """Running sums that never fall below 0, and the first day the target is reached.

    With all prior sums known, the fold max(0, x + d) equals the sum minus its lowest
    value so far (0 included), which is a window instead of an ordered fold.
    """
    order = Window.partitionBy("user_id").orderBy("txn_date", "txn_id")
    summed = contributions.withColumn("total", F.sum("delta").over(order))
    lowest = F.least(F.lit(0).cast("decimal(24,2)"), F.min("total").over(order))
    current = summed.withColumn("current", F.col("total") - lowest)
    last = F.max_by("current", F.struct("txn_date", "txn_id"))
    return current.groupBy("user_id").agg(last.alias("current"), F.min(F.when(F.col("current") >= target, F.col("txn_date"))).alias("completed_on"))


def import_trace(jobs: DataFrame, analyses: DataFrame, stages: DataFrame, findings: DataFrame, learnt: DataFrame) -> DataFrame:
    """One row for each import known as a job or as an analysis, or both, by ``trace``, with its stages, findings and learning events if it has any."""
    both = jobs.join(analyses, "trace", "full_outer")
    whole = both.join(stages, "trace", "left").join(findings, "trace", "left").join(learnt, "trace", "left")
    return whole.fillna(0, ["findings", "learning_events"])
