"""Edits: what is run again gives what a whole run gives."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, rerun

KIND = "txn_id string, user_id long, account_id long, txn_date date, amount decimal(14,2), txn_type string, description string, merchant string, created_at timestamp, confirmed_at timestamp"


def ledger(rng, users=4, rows=60):
    out = []
    for k in range(rows):
        user, day = rng.randrange(users), rng.choice([rng.randint(0, 90), rng.randint(400, 500), rng.randint(900, 930)])
        kind = rng.choice(["INCOME", "EXPENSE", "EXPENSE"])
        text = rng.choice(["card payment", "refund of shop", "shop", "transfer to x", "shop"])
        out.append((f"t{k:03d}", user, user * 10 + rng.randrange(2), date(2020, 1, 1) + timedelta(days=day), Decimal(rng.choice([5, 10, 20])), kind, text, rng.choice(["shop", "cafe", "Shop"]), datetime(2024, 1, 1) + timedelta(minutes=k), None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_those_of_a_whole_run(spark, seed):
    rng = random.Random(seed)
    rows = ledger(rng)
    changed = []
    for r in rows:
        draw = rng.random()
        if draw < 0.05:
            continue
        if draw < 0.1:
            r = (*r[:3], r[3] + timedelta(days=rng.randint(-200, 200)), *r[4:6], "card payment", *r[7:])
        changed.append(r)
    changed += [(f"n{k}", *r[1:]) for k, r in enumerate(rng.sample(rows, 3))]
    before, after = (spark.createDataFrame(x, KIND).cache() for x in (rows, changed))
    known, whole = rerun.marks(before).cache(), rerun.marks(after)
    changes = rerun.rerun(before, after, known).cache()
    want = sorted(whole.collect(), key=str)
    assert sorted(rerun.applied(known, after, changes).collect(), key=str) == want
    assert len({r["status"] for r in want}) >= 3
    # nothing is named that doesn't change
    old = {r["txn_id"]: tuple(r) for r in known.collect()}
    assert all(tuple(r) != old.get(r["txn_id"], (r["txn_id"], None, None, None, "OK")) for r in changes.collect())
    groups, again = rerun.recurring_again(before, after, known, changes)
    marked = after.join(whole, "txn_id").withColumn("is_transfer", F.col("status") == "TRANSFER")
    full = analytics.recurring(marked).join(groups, ["user_id", "merchant"], "left_semi")
    assert sorted(map(str, again.collect())) == sorted(map(str, full.select(again.columns).collect()))


def test_only_the_edited_island_is_read_again(spark):
    rng = random.Random(5)
    rows = ledger(rng)
    one = next(r for r in rows if r[3] < date(2020, 6, 1))
    before, after = spark.createDataFrame(rows, KIND), spark.createDataFrame([r for r in rows if r != one], KIND)
    reach = rerun.islands(before, after, rerun.edited(before, after)).collect()
    assert len(reach) == 1 and reach[0]["user_id"] == one[1] and reach[0]["low"] <= one[3] <= reach[0]["high"] < date(2020, 9, 1)
    known = rerun.marks(before)
    assert rerun.rerun(before, before, known).collect() == []


def edit_of(rng, rows):
    changed = []
    for r in rows:
        draw = rng.random()
        if draw < 0.06:
            continue
        if draw < 0.12 and r[3]:
            r = (*r[:3], r[3] + timedelta(days=rng.randint(-200, 200)), *r[4:6], rng.choice(["card payment", "refund of shop", None]), *r[7:])
        changed.append(r)
    return changed + [(f"n{k}", *r[1:]) for k, r in enumerate(rng.sample(rows, 3))]


@pytest.mark.parametrize("seed", [3, 4])
def test_two_versions_differ_as_their_whole_runs(spark, seed):
    rng = random.Random(seed)
    odd = [(f"z{k}", *r) for k, r in enumerate([(1, 10, None, Decimal(5), "EXPENSE", "shop", "shop"), (1, 10, None, Decimal(5), "EXPENSE", "shop", "shop"), (None, 10, date(2020, 1, 5), Decimal(5), "INCOME", "card payment", "shop"), (1, None, date(2020, 1, 5), Decimal(5), "INCOME", "refund of shop", "shop"), (1, 11, date(2020, 1, 5), None, "INCOME", "refund of shop", "shop"), (1, 11, date(2020, 1, 6), Decimal(5), None, "card payment", None), (1, 11, date(2020, 1, 6), Decimal("-5.50"), "INCOME", "refund", " "), (1, 11, date(2020, 1, 5), Decimal("-5.25"), "EXPENSE", "card payment", " "), (1, 10, date(2020, 1, 5), Decimal("5.99"), "INCOME", "salary card payment", "x")])]
    rows = [*ledger(rng, 30, 1500), *[(*r, datetime(2024, 2, 1), None if k % 2 else datetime(2024, 3, 1)) for k, r in enumerate(odd)]]
    changed = edit_of(rng, rows)
    before, after = (spark.createDataFrame(x, KIND) for x in (rows, changed))
    old, new = ({r["txn_id"]: tuple(r) for r in rerun.marks(x).collect()} for x in (before, after))
    want = {t: r for t, r in new.items() if old.get(t, (t, None, None, None, "OK")) != r}
    both = before.withColumn("after", F.lit(False)).union(after.withColumn("after", F.lit(True)))
    found = rerun.between(both).collect()
    assert {r["txn_id"]: tuple(r) for r in found} == want and len(found) == len(want)
    assert {r["status"] for r in found} == {r[-1] for r in new.values()} == {"OK", "DUPLICATE", "TRANSFER", "REFUND"}
    same = before.withColumn("after", F.explode(F.array(F.lit(False), F.lit(True))))
    assert rerun.between(same).collect() == []


def test_a_rerun_deals_the_rows_once_and_writes_nothing(spark):
    from ledgerloom.plans import reconcile as plans
    from ledgerloom.sources import views

    plan = plans.d8_incremental(views.Book(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    # no step reads a checkpoint; the only join is that of the lines with their parts
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("FileScan parquet") == 2 and "Scan ExistingRDD" not in plan
    assert plan.count("Join") == 1
