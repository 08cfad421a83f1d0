"""Reconciliation after edits: only what an edit can reach is run again, and the changes are those of a whole run.

Duplicates, transfers and refunds look at most ``REFUND_DAYS`` back, so a user's history falls into islands: runs of days without a longer
gap, before or after the edit. What an edit changes lies in its island; recurring charges are a merchant's, whatever the date.
An account is one user's.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions import text
from . import analytics, reconcile
from .folds import folded

MARKS = ["duplicate_of", "transfer_with", "refund_of", "status"]


def marks(rows: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """txn_id, duplicate_of, transfer_with, refund_of and status of every row: duplicates first, then transfers among the rest, then refunds."""
    # the rows are written once with their mark as a duplicate; all that follows reads that, and only the chosen ids meet by txn_id
    placed = reconcile.saved(reconcile.with_originals(rows).select(*rows.columns, "duplicate_of"))
    left = placed.where("duplicate_of is null").drop("duplicate_of").withColumn("status", F.lit("OK"))
    pairs = reconcile.saved(reconcile.transfers(reconcile.transfer_candidates(left, identifiers)))
    sides = pairs.select(F.col("a_id").alias("txn_id"), F.col("b_id").alias("transfer_with")).union(pairs.select("b_id", "a_id"))
    left = left.join(sides.select("txn_id"), "txn_id", "left_anti")
    back = reconcile.refunds(reconcile.refund_candidates(left)).select(F.col("income_id").alias("txn_id"), F.col("expense_id").alias("refund_of"))
    paired = sides.withColumn("refund_of", F.lit(None).cast("string")).union(back.select("txn_id", F.lit(None).cast("string"), "refund_of"))
    found = placed.select("txn_id", "duplicate_of").join(paired, "txn_id", "left")
    status = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("transfer_with").isNotNull(), "TRANSFER").when(F.col("refund_of").isNotNull(), "REFUND").otherwise("OK")
    return found.withColumn("status", status).select("txn_id", *MARKS)


def edited(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that were removed, added or changed, each version that there is once: the columns of ``after``."""
    both = before.select(after.columns).withColumn("_n", F.lit(1)).union(after.withColumn("_n", F.lit(-1)))
    return both.groupBy(*after.columns).agg(F.sum("_n").alias("_n")).where("_n != 0").drop("_n")


def islands(before: DataFrame, after: DataFrame, edits: DataFrame, days: int = reconcile.REFUND_DAYS) -> DataFrame:
    """user_id, low and high of the runs of days in which a row was edited. A user's days are few, however many rows they have."""
    every = before.select("user_id", "txn_date").union(after.select("user_id", "txn_date")).groupBy("user_id", "txn_date").agg(F.lit(0).alias("edits"))
    touched = edits.select("user_id", "txn_date").distinct().withColumn("hit", F.lit(1))
    order = Window.partitionBy("user_id").orderBy("txn_date")
    begins = F.coalesce((F.datediff("txn_date", F.lag("txn_date").over(order)) > days).cast("int"), F.lit(1))
    placed = every.join(touched, ["user_id", "txn_date"], "left").withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    return placed.groupBy("user_id", "island").agg(F.min("txn_date").alias("low"), F.max("txn_date").alias("high"), F.max("hit").alias("hit")).where("hit = 1").select("user_id", "low", "high")


def rerun(before: DataFrame, after: DataFrame, known: DataFrame, identifiers: DataFrame | None = None) -> DataFrame:
    """The changed marks of ``after``'s rows: txn_id and ``MARKS``, as a whole run would set them.

    ``before`` and ``after`` are the ledger's rows (txn_id, user_id, account_id, txn_date, amount, txn_type, description, merchant, created_at, confirmed_at) around
    the edit, ``known`` the marks of ``before``. Removed rows have none any more; a new row counts as OK before. Only islands with an edit are read again.
    """
    edits = reconcile.saved(edited(before, after))
    reach = reconcile.saved(islands(before, after, edits))
    inside = lambda rows: rows.join(reach, "user_id").where(F.col("txn_date").between(F.col("low"), F.col("high"))).drop("low", "high")
    fresh = marks(inside(after), identifiers)
    old = known.select("txn_id", *[F.col(m).alias(f"was_{m}") for m in MARKS])
    both = fresh.join(old, "txn_id", "left").withColumn("was_status", F.coalesce("was_status", F.lit("OK")))
    differs = None
    for m in MARKS:
        part = ~F.col(m).eqNullSafe(F.col(f"was_{m}"))
        differs = part if differs is None else differs | part
    return both.where(differs).select("txn_id", *MARKS)


class _Version:
    """One version of a user's ledger, read by days: a day's transfers are taken when the days that its rows reach are there, its refunds when
    no later day's transfers reach it. Held are the rows of twice the reach and each account's purchases of REFUND_DAYS."""

    REACH = reconcile.TRANSFER_DAYS

    def __init__(self, one):
        #: What an amount of 1 is in the rows.
        self.one = one
        #: Days that are not final, as (day, rows); how many of them have had their transfers taken.
        self.days, self.tried = deque(), 0
        #: Free rows by type and whole amount, in order of day and id.
        self.free: dict = {}
        self.bought: dict = {}

    def add(self, row):
        """A row as [txn_id, day, account, amount, type, may be a transfer's side, looks like one, says refund, merchant, whole amount, its other side]."""
        if not self.days or self.days[-1][0] != row[1]:
            self.days.append((row[1], []))
        self.days[-1][1].append(row)
        if row[5]:
            self.free.setdefault(row[4], {}).setdefault(row[9], deque()).append(row)

    def until(self, day):
        """txn_id, transfer_with and refund_of of the rows that are final once a row of ``day`` comes; None: no row comes any more."""
        while self.tried < len(self.days) and (day is None or self.days[self.tried][0] + self.REACH < day):
            for row in self.days[self.tried][1]:
                if row[6] and row[10] is None:
                    self.pair(row)
            self.tried += 1
        found = []
        while self.tried and (day is None or self.days[0][0] + 2 * self.REACH < day):
            found += self.refunded(*self.days.popleft())
            self.tried -= 1
        return found

    def pair(self, a):
        """The first free row, by day and id, that may be the other side of ``a``, becomes that."""
        day, account, amount, kind, whole = a[1], a[2], a[3], a[4], a[9]
        best = None
        for other, cells in self.free.items():
            if other == kind:
                continue
            for cell in (whole - 1, whole, whole + 1):
                for b in cells.get(cell, ()):
                    if b[1] > day + self.REACH or best is not None and (b[1], b[0]) > (best[1], best[0]):
                        break
                    if b[1] >= day - self.REACH and b[2] != account and abs(b[3] - amount) < self.one:
                        best = b
                        break
        if best is not None:
            a[10], best[10] = best[0], a[0]
            self.leave(a)
            self.leave(best)

    def leave(self, row):
        cells = self.free[row[4]]
        cell = cells[row[9]]
        # by its place: rows that are equal are none the less different ones
        del cell[next(i for i, r in enumerate(cell) if r is row)]
        if not cell:
            del cells[row[9]]

    def refunded(self, day, rows):
        """A final day: its purchases first, then its incomes in order, each with the best purchase that has as much left."""
        for row in rows:
            if row[10] is None and row[5]:
                self.leave(row)
            if row[10] is None and row[4] == "EXPENSE":
                self.bought.setdefault(row[2], deque()).append([row[1], row[0], row[3], row[8], row[3]])
        for txn, _, account, amount, kind, _, _, says, merchant, _, mate in rows:
            best = None
            if mate is None and kind == "INCOME":
                bought = self.bought.get(account, deque())
                while bought and bought[0][0] < day - reconcile.REFUND_DAYS:
                    bought.popleft()
                for b in bought:
                    # exact amounts first, then the fewest days, then the id: purchases come in order of day and id
                    if amount <= b[4] and amount <= b[2] and (says or merchant is not None and merchant == b[3]) and (best is None or (b[2] == amount, b[0]) > (best[2] == amount, best[0])):
                        best = b
                if best is not None:
                    best[4] -= amount
            yield txn, mate, best and best[1]


def between(both: DataFrame, days: int = reconcile.REFUND_DAYS) -> DataFrame:
    """The changed marks of an edited ledger's rows, txn_id and ``MARKS``, as two whole runs would set them: a new row counts as OK before.

    ``both`` holds both versions' rows (as for ``rerun``, and after: false for the version before the edit, true for the one after it). They are
    dealt by user once, if they aren't yet; only islands with an edit are read, by one fold that compares a row's marks of both versions. Nothing but the
    rows is shuffled, and nothing is joined or written. A user's rows are one task's, as a stream.
    """
    columns = [c for c in both.columns if c != "after"]
    # one order serves for duplicates, edits and islands, another one for the islands' edits and the fold
    first = ["user_id", "txn_date", "account_id", "amount", "description"]
    rest = [c for c in columns if c not in [*first, "created_at", "txn_id"]]
    alike = Window.partitionBy(*first).orderBy("created_at", "txn_id")
    earliest = lambda version: F.first(F.when(version, F.col("txn_id")), ignorenulls=True).over(alike)
    original = F.when(F.col("after"), earliest(F.col("after"))).otherwise(earliest(~F.col("after")))
    marked = F.col("description").isNotNull() & (F.col("original") != F.col("txn_id")) & F.col("confirmed_at").isNull()
    edit = F.sum(F.when(F.col("after"), -1).otherwise(1)).over(Window.partitionBy(*first, "created_at", "txn_id", *rest)) != 0
    order = Window.partitionBy("user_id").orderBy("txn_date")
    begins = F.coalesce((F.datediff("txn_date", F.lag("txn_date").over(order)) > days).cast("int"), F.lit(0))
    island = Window.partitionBy("user_id", "island").orderBy("txn_date", "txn_id", "after").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = both.repartition("user_id").sortWithinPartitions(*first, "created_at", "txn_id", *rest).withColumn("original", original).withColumn("duplicate_of", F.when(marked, F.col("original"))).drop("original")
    rows = rows.withColumn("edit", edit).withColumn("begins", begins).withColumn("island", F.sum("begins").over(order)).withColumn("hit", F.max("edit").over(island)).where("hit")
    norm = text.normalize(F.col("description"))
    whole = F.expr("user_id is not null and txn_date is not null and account_id is not null and amount is not null and duplicate_of is null")
    side = F.coalesce(whole & F.col("txn_type").isNotNull() & ~text.is_salary(norm), F.lit(False))
    kind = both.schema["amount"].dataType
    # small decimals are read as whole numbers of their unit
    one = 10**kind.scale if isinstance(kind, DecimalType) and kind.precision + kind.scale <= 18 else 1
    amount = F.col("amount") if one == 1 else (F.col("amount") * one).cast("long")
    told = rows.select(
        "user_id", "island", "txn_date", "txn_id", "after", F.datediff("txn_date", F.lit("1970-01-01").cast("date")).alias("day"), "duplicate_of", whole.alias("whole"), "account_id", amount.alias("amount"), "txn_type", side.alias("side"),
        (side & norm.contains("payment")).alias("looks"), F.coalesce(text.mentions_refund(F.col("description")), F.lit(False)).alias("says"), F.when(F.trim("merchant") != "", F.lower("merchant")).alias("shop"), F.floor("amount").cast("long").alias("cell"),
    )
    plain = (None, None, None)

    def start():
        # a row's marks wait for those of its other version
        return {False: _Version(one), True: _Version(one), "marks": ({}, {}), "day": None}

    def settle(state, after, found):
        old, new = state["marks"]
        own, others = (new, old) if after else (old, new)
        for txn, *marks in found:
            marks = tuple(marks)
            if txn not in others:
                own[txn] = marks
            elif (was := others.pop(txn)) != marks:
                yield change(txn, marks if after else was)

    def change(txn, marks):
        return (txn, *marks, next((s for s, m in zip(("DUPLICATE", "TRANSFER", "REFUND"), marks, strict=True) if m is not None), "OK"))

    def step(state, row):
        _, _, _, txn, after, day, duplicate, whole, account, amount, kind, side, looks, says, shop, cell = row
        out = []
        if day is not None and day != state["day"]:
            state["day"] = day
            for version in (False, True):
                out += settle(state, version, [(t, None, *m) for t, *m in state[version].until(day)])
        if whole:
            state[after].add([txn, day, account, amount, kind, side, looks, says, shop, cell, None])
        else:
            out += settle(state, after, [(txn, duplicate, None, None)])
        return out

    def finish(_, state):
        out = []
        for version in (False, True):
            out += settle(state, version, [(t, None, *m) for t, *m in state[version].until(None)])
        return out + [change(txn, marks) for txn, marks in state["marks"][1].items() if marks != plain]

    found = folded(told, ["user_id"], ["island", "txn_date", "txn_id", "after"], start, step, "txn_id string, duplicate_of string, transfer_with string, refund_of string, status string", finish, dealt=True)
    return found.select("txn_id", *MARKS)


def applied(known: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """The marks of ``after``'s rows: the changes, else what was known, else OK."""
    new = changes.select("txn_id", F.struct(*MARKS).alias("new"))
    old = known.select("txn_id", F.struct(*MARKS).alias("old"))
    rows = after.select("txn_id").join(new, "txn_id", "left").join(old, "txn_id", "left")
    chosen = F.coalesce("new", "old")
    return rows.select("txn_id", *[chosen[m].alias(m) for m in MARKS[:-1]], F.coalesce(chosen["status"], F.lit("OK")).alias("status"))


def recurring_again(before: DataFrame, after: DataFrame, known: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, merchant) whose recurring charge may have changed, and the charges found among them now: what a whole run finds for these."""
    edits = edited(before, after)
    moved = after.join(changes.select("txn_id"), "txn_id", "left_semi").select("user_id", "merchant")
    groups = reconcile.saved(edits.select("user_id", "merchant").union(moved).where("merchant is not null").distinct())
    rows = after.join(groups, ["user_id", "merchant"], "left_semi").join(applied(known, after, changes), "txn_id")
    return groups, analytics.recurring(rows.withColumn("is_transfer", F.col("status") == "TRANSFER"))
