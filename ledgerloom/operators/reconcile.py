"""Duplicates, internal transfers and refunds.

Candidate pairs come from equi-joins on a key and a bucket of days, so no pass compares
all rows of a user. The order-dependent choices work on those pairs only: transfers in rounds in
which every locally first pair is taken at once, which gives the same matching as taking
pairs one by one in order; refunds, whose capacity is used up in order, by a fold over each account's pairs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .folds import folded

TRANSFER_DAYS, OWN_ACCOUNT_DAYS, REFUND_DAYS, RECEIPT_DAYS = 4, 10, 180, 3
#: Pairs of one user that a task tries one after the other.
FOLDED_PAIRS = 2_000_000


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the folder that the cluster names; without one, a local session gets one and a cluster an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return df.checkpoint()


def near_days(left: DataFrame, right: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Pairs of rows with equal keys and right date in [left date - before, left date + after].

    Columns come as structs a and b. The left side goes into each bucket its range touches.
    """
    width = before + after + 1
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    low, high = F.floor((day("txn_date") - before) / width), F.floor((day("txn_date") + after) / width)
    a = left.select(F.struct(*left.columns).alias("a"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.explode(F.sequence(low, high)).alias("bucket"))
    b = right.select(F.struct(*right.columns).alias("b"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.floor(day("txn_date") / width).alias("bucket"))
    pairs = a.join(b, [*[f"k{i}" for i in range(len(keys))], "bucket"]).drop("bucket")
    gap = F.datediff("b.txn_date", "a.txn_date")
    return pairs.where(gap.between(-before, after))


def with_originals(rows: DataFrame) -> DataFrame:
    """The rows with duplicate_of: the first row of an account with the same date, amount and description, null for that row itself.

    Null descriptions make rows unique; rows confirmed as no duplicates aren't marked but may be the first.
    """
    order = Window.partitionBy("account_id", "txn_date", "amount", "description").orderBy("created_at", "txn_id")
    original = F.first("txn_id").over(order)
    marked = F.col("description").isNotNull() & (F.col("original") != F.col("txn_id")) & F.col("confirmed_at").isNull()
    return rows.withColumn("original", original).withColumn("duplicate_of", F.when(marked, F.col("original"))).drop("original")


def duplicates(rows: DataFrame) -> DataFrame:
    """txn_id and duplicate_of of the rows that ``with_originals`` marks."""
    return with_originals(rows.where("description is not null")).where("duplicate_of is not null").select("txn_id", "duplicate_of")


def transfer_candidates(rows: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that may be the two sides of a transfer, with their order."""
    marked = rows.withColumn("norm", text.normalize(F.col("description"))).withColumn("salary", text.is_salary(F.col("norm")))
    reach = OWN_ACCOUNT_DAYS
    if identifiers is None:
        marked, reach = marked.withColumn("own", F.lit(False)), TRANSFER_DAYS
    else:
        # identifiers are a user's own: an equi-join on the user, then a substring test
        own = marked.select("txn_id", "user_id", "norm").join(identifiers, "user_id").where(F.contains("norm", "identifier")).select("txn_id").distinct().withColumn("own", F.lit(True))
        marked = marked.join(own, "txn_id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    looks = ~F.col("salary") & (F.col("own") | F.col("norm").contains("payment"))
    cols = ["txn_id", "account_id", "txn_date", "amount", "txn_type", "own", "user_id"]
    pairs = near_days(marked.where(looks).select(*cols), marked.where(~F.col("salary")).select(*cols), ["user_id"], reach, reach)
    days = F.abs(F.datediff("a.txn_date", "b.txn_date"))
    fits = (F.col("a.account_id") != F.col("b.account_id")) & (F.col("a.txn_type") != F.col("b.txn_type")) & (F.abs(F.col("a.amount") - F.col("b.amount")) < 1)
    near = days <= F.when(F.col("a.own") | F.col("b.own"), OWN_ACCOUNT_DAYS).otherwise(TRANSFER_DAYS)
    return pairs.where(fits & near).select(F.col("a.user_id").alias("user_id"), F.col("a.txn_id").alias("a_id"), F.col("b.txn_id").alias("b_id"), F.col("a.txn_date").alias("a_date"), F.col("b.txn_date").alias("b_date"))


def transfers(candidates: DataFrame, most: int = FOLDED_PAIRS) -> DataFrame:
    """The pairs that are taken if pairs are tried in order of (a, b), each row in one pair at most.

    A user's pairs are tried one after the other as a stream. Users with more than ``most`` pairs, which one task would be long at, are
    taken in rounds instead: every pair that is the first of both its rows is taken, and what it meets goes; the result is the same.
    Pairs without a user_id are taken in rounds.
    """
    if "user_id" not in candidates.columns:
        return _in_rounds(candidates)
    pairs = saved(candidates.select("user_id", "a_id", "b_id", "a_date", "b_date"))
    large = pairs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("user_id")
    if large.head() is None:
        return _tried(pairs)
    large = saved(large)
    return _tried(pairs.join(large, "user_id", "left_anti")).union(_in_rounds(pairs.join(large, "user_id", "left_semi")))


def _tried(pairs: DataFrame) -> DataFrame:
    """The pairs taken, each user's in order; a state holds the rows taken of the days that pairs still reach."""

    def take(state, row):
        _, a_day, a, b_day, b = row
        if a_day != state["day"]:
            state["day"] = a_day
            # both rows of a pair lie within OWN_ACCOUNT_DAYS
            state["used"] = {k: d for k, d in state["used"].items() if d >= a_day - 2 * OWN_ACCOUNT_DAYS}
        if a in state["used"] or b in state["used"]:
            return ()
        state["used"] |= {a: a_day, b: b_day}
        return ((a, b),)

    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long").alias(c)
    rows = pairs.select("user_id", day("a_date"), "a_id", day("b_date"), "b_id")
    return folded(rows, ["user_id"], ["a_date", "a_id", "b_date", "b_id"], lambda: {"day": None, "used": {}}, take, "a_id string, b_id string")


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The same pairs for users of any size: no user is one task's, and rounds follow the longest chain of conflicts."""
    left = saved(pairs.select("a_id", "b_id", F.struct("a_date", "a_id", "b_date", "b_id").alias("turn")))
    taken = None
    while left.head() is not None:
        ends = left.select(F.col("a_id").alias("id"), "turn").union(left.select(F.col("b_id"), "turn"))
        first = ends.groupBy("id").agg(F.min("turn").alias("first"))
        chosen = left.join(first.select(F.col("id").alias("a_id"), F.col("first").alias("fa")), "a_id").join(first.select(F.col("id").alias("b_id"), F.col("first").alias("fb")), "b_id").where("turn = fa and turn = fb").select("a_id", "b_id")
        chosen = saved(chosen)
        taken = chosen if taken is None else taken.union(chosen)
        gone = chosen.select(F.col("a_id").alias("gone")).union(chosen.select("b_id"))
        left = saved(left.join(gone, F.col("a_id") == F.col("gone"), "left_anti").join(gone, F.col("b_id") == F.col("gone"), "left_anti"))
    return taken if taken is not None else left.select("a_id", "b_id")


def refund_candidates(rows: DataFrame) -> DataFrame:
    """Pairs of an income and an earlier purchase of the same account that it may refund."""
    cols = ["txn_id", "user_id", "account_id", "txn_date", "amount", "merchant", "description"]
    income = rows.where("txn_type = 'INCOME' and status = 'OK'").select(*cols, text.mentions_refund(F.col("description")).alias("says"))
    pairs = near_days(income, rows.where("txn_type = 'EXPENSE'").select(*cols), ["user_id", "account_id"], REFUND_DAYS, 0)
    same = (F.trim("a.merchant") != "") & (F.lower("a.merchant") == F.lower("b.merchant"))
    kept = pairs.where((F.col("a.says") | F.coalesce(same, F.lit(False))) & (F.col("a.amount") <= F.col("b.amount")))
    return kept.select(F.col("a.user_id").alias("user_id"), F.col("a.account_id").alias("account_id"), F.col("a.txn_id").alias("income_id"), F.col("b.txn_id").alias("expense_id"), F.col("a.txn_date").alias("income_date"), F.col("b.txn_date").alias("expense_date"), F.col("a.amount").alias("income_amount"), F.col("b.amount").alias("expense_amount"))


def refund_order() -> list[Column]:
    """Exact amounts first, then the fewest days, then the earliest purchase."""
    return [F.when(F.col("income_amount") == F.col("expense_amount"), 0).otherwise(1), F.datediff("income_date", "expense_date"), F.col("expense_date"), F.col("expense_id")]


def best_refunds(candidates: DataFrame) -> DataFrame:
    """Each income's best purchase, whatever other incomes take of it."""
    best = candidates.withColumn("place", F.row_number().over(Window.partitionBy("income_id").orderBy(*refund_order()))).where("place = 1")
    return best.select("income_id", "expense_id")


def refunds(candidates: DataFrame) -> DataFrame:
    """income_id and expense_id, incomes in order of date and id, each taking of its purchase's remaining amount.

    The order is an account's, so its pairs are folded in order, batch by batch; a state holds what is taken of
    purchases that have refunds.
    """

    def start():
        return {"used": {}, "income": None, "done": False}

    def take(state, row):
        income, expense, wanted, whole = row[2:6]
        if income != state["income"]:
            state["income"], state["done"] = income, False
        if state["done"] or wanted > whole - state["used"].get(expense, 0):
            return ()
        state["used"][expense] = state["used"].get(expense, 0) + wanted
        state["done"] = True
        return ((income, expense),)

    names = ["user_id", "account_id", "income_id", "expense_id", "income_amount", "expense_amount", "income_date", "expense_date"]
    return folded(candidates.select(*names), ["user_id", "account_id"], ["income_date", "income_id", *refund_order()], start, take, "income_id string, expense_id string")


def receipt_matches(receipts: DataFrame, lines: DataFrame, least: float = 0.6) -> DataFrame:
    """Each receipt's best bank line: same amount, within three days, similar names."""
    pairs = near_days(receipts, lines, ["user_id", "amount"], RECEIPT_DAYS, RECEIPT_DAYS)
    alike = text.similarity(text.normalize(F.col("a.description")), text.normalize(F.col("b.description")))
    scored = pairs.select(F.col("a.txn_id").alias("receipt_id"), F.col("b.txn_id").alias("line_id"), F.round(alike, 6).alias("similarity"), F.abs(F.datediff("a.txn_date", "b.txn_date")).alias("days")).where(F.col("similarity") >= least)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("receipt_id").orderBy(F.desc("similarity"), "days", "line_id"))).where("place = 1").drop("place")


def changes_near_import(rows: DataFrame, imports: DataFrame, days: int = REFUND_DAYS) -> DataFrame:
    """The users' rows within ``days`` of an import's dates."""
    bounds = imports.groupBy("user_id").agg(F.date_sub(F.min("txn_date"), days).alias("low"), F.date_add(F.max("txn_date"), days).alias("high"))
    return rows.join(bounds, "user_id").where(F.col("txn_date").between(F.col("low"), F.col("high"))).drop("low", "high")


def reset_pointers(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Survivors of a removal whose duplicate_of or refund_of pointed at a removed row, back to OK."""
    ids = removed.select(F.col("txn_id").alias("gone_id")).distinct()
    # most rows point nowhere: their nulls would all meet in one task
    alive = rows.where(F.coalesce("duplicate_of", "refund_of").isNotNull()).join(ids, F.col("txn_id") == F.col("gone_id"), "left_anti")
    hit = alive.join(ids, (F.coalesce("duplicate_of", "refund_of") == F.col("gone_id")), "left_semi")
    return hit.select("txn_id", F.lit("OK").alias("status"), F.col("status").alias("was"))


def dangling(rows: DataFrame) -> DataFrame:
    """Number of duplicate_of and refund_of pointers whose target isn't there."""
    ids = rows.select(F.col("txn_id").alias("target"))
    parts = [rows.where(F.col(c).isNotNull()).join(ids, F.col(c) == F.col("target"), "left_anti").agg(F.lit(c).alias("pointer"), F.count("*").alias("dangling")) for c in ("duplicate_of", "refund_of")]
    return parts[0].unionByName(parts[1])
