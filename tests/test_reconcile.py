"""Reconciliation, netting and recurring scenarios, a few rows each."""

from datetime import date, datetime, timedelta
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics as A
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import reconcile as plan

SCHEMA = "txn_id string, user_id long, account_id long, txn_date date, amount decimal(14,2), txn_type string, description string, merchant string, status string, created_at timestamp, confirmed_at timestamp"
DAY = date(2024, 3, 10)


def row(txn_id, amount=100, kind="EXPENSE", days=0, account=1, text="coffee shop", merchant="m", user=1, created=0, confirmed=None, status="OK"):
    return (txn_id, user, account, DAY + timedelta(days=days), Decimal(amount), kind, text, merchant, status, datetime(2024, 3, 1) + timedelta(minutes=created), confirmed)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def dups(frame, *rows):
    return {(r[0], r[1]) for r in R.duplicates(frame(rows)).collect()}


def test_earliest_is_the_original(frame):
    assert dups(frame, row("b", created=5), row("a", created=9), row("c", created=1)) == {("a", "c"), ("b", "c")}


def test_other_account_amount_date_or_null_text_are_no_duplicates(frame):
    assert dups(frame, row("a"), row("b", account=2), row("c", amount=101), row("d", days=1), row("e", text=None), row("f", text=None)) == set()


def test_confirmed_rows_stay_but_may_be_the_original(frame):
    at = datetime(2024, 4, 1)
    assert dups(frame, row("a", confirmed=at), row("b", created=1), row("c", created=2, confirmed=at)) == {("b", "a")}


def pairs(frame, *rows, ids=None):
    return {(r[0], r[1]) for r in R.transfers(R.transfer_candidates(frame(rows), ids)).collect()}


def test_transfer_between_accounts(frame):
    assert pairs(frame, row("a", text="card payment"), row("b", kind="INCOME", account=2, days=2)) == {("a", "b")}


@pytest.mark.parametrize("days, found", [(4, True), (5, False)])
def test_transfer_window(frame, days, found):
    assert bool(pairs(frame, row("a", text="payment"), row("b", kind="INCOME", account=2, days=days))) is found


@pytest.mark.parametrize("days, found", [(10, True), (11, False)])
def test_own_account_identifier_widens_the_window(spark, frame, days, found):
    ids = spark.createDataFrame([(1, "my upi")], "user_id long, identifier string")
    assert bool(pairs(frame, row("a", text="to my upi"), row("b", kind="INCOME", account=2, days=days), ids=ids)) is found


def test_transfer_needs_other_account_opposite_type_and_near_amount(frame):
    assert pairs(frame, row("a", text="payment"), row("b", kind="INCOME", days=1), row("c", account=2), row("d", kind="INCOME", account=2, amount=101)) == set()


def test_salary_is_no_transfer(frame):
    assert pairs(frame, row("a", text="payment"), row("b", kind="INCOME", account=2, text="salary march")) == set()


def test_first_in_order_wins_and_each_row_pairs_once(frame):
    rows = [row("a", text="payment"), row("b", text="payment", days=1), row("c", kind="INCOME", account=2, days=1), row("d", kind="INCOME", account=2, days=2)]
    assert pairs(frame, *rows) == {("a", "c"), ("b", "d")}


def test_rounds_equal_the_sequential_choice(spark):
    import random

    rng = random.Random(3)
    edges = sorted({(f"a{rng.randint(0, 30):02}", f"b{rng.randint(0, 30):02}") for _ in range(150)})
    used, want = set(), set()
    for a, b in edges:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    frame = spark.createDataFrame([(a, b, DAY, DAY) for a, b in edges], "a_id string, b_id string, a_date date, b_date date")
    assert {(r[0], r[1]) for r in R.transfers(frame).collect()} == want


def refunds(frame, *rows):
    return {(r[0], r[1]) for r in R.refunds(R.refund_candidates(frame(rows))).collect()}


def test_refund_by_merchant_and_by_word(frame):
    assert refunds(frame, row("e"), row("i", kind="INCOME", days=5)) == {("i", "e")}
    assert refunds(frame, row("e"), row("i", kind="INCOME", days=5, merchant="x", text="Refund of order")) == {("i", "e")}
    assert refunds(frame, row("e"), row("i", kind="INCOME", days=5, merchant="x")) == set()


def test_refund_window_account_and_amount(frame):
    assert refunds(frame, row("e", days=-181), row("i", kind="INCOME")) == set()
    assert refunds(frame, row("e", days=-180), row("i", kind="INCOME")) == {("i", "e")}
    assert refunds(frame, row("e", account=2), row("i", kind="INCOME")) == set()
    assert refunds(frame, row("e", amount=50), row("i", kind="INCOME")) == set()


def test_exact_amount_before_nearest_day(frame):
    assert refunds(frame, row("far", days=-9), row("near", amount=150, days=-1), row("i", kind="INCOME")) == {("i", "far")}


def test_refunds_use_up_the_purchase(frame):
    rows = [row("e", amount=100, days=-5), row("i1", amount=60, kind="INCOME"), row("i2", amount=60, kind="INCOME", days=1), row("i3", amount=40, kind="INCOME", days=2)]
    assert refunds(frame, *rows) == {("i1", "e"), ("i3", "e")}


def test_queries_without_sql_reconcile_every_year(spark, frame):
    new_year = (date(1999, 12, 30) - DAY).days
    book = lambda *rows: SimpleNamespace(base=frame(rows).drop("status").withColumn("ym", F.date_format("txn_date", "yyyy-MM")))
    moved = book(row("a", text="payment", days=new_year), row("b", kind="INCOME", account=2, days=new_year + 3), row("c", text="payment", days=new_year - 900), row("d", kind="INCOME", account=2, days=new_year - 899))
    assert {tuple(r) for r in plan.d2(moved).collect()} == {("a", "b"), ("c", "d")}
    returned = book(row("e", days=new_year), row("i", kind="INCOME", days=new_year + 150), row("f", days=new_year - 900), row("j", kind="INCOME", days=new_year - 890))
    assert {tuple(r) for r in plan.d3(returned).collect()} == {("i", "e"), ("j", "f")}


LEDGER = "txn_id string, user_id long, txn_date date, ym string, merchant string, category string, amount decimal(14,2), txn_type string, duplicate_of string, is_transfer boolean, refund_of string, status string"


def entry(txn_id, amount, kind="EXPENSE", ym="2024-03", day=1, status="OK", refund_of=None, duplicate_of=None, transfer=False, merchant="m"):
    return (txn_id, 1, date(int(ym[:4]), int(ym[5:]), day), ym, merchant, "c", Decimal(amount), kind, duplicate_of, transfer, refund_of, status)


def test_netting(spark):
    rows = [entry("e", 100), entry("r", 30, "INCOME", "2024-05", status="REFUND", refund_of="e"), entry("f", 50), entry("g", 70, "INCOME", status="REFUND", refund_of="f"), entry("d", 5, duplicate_of="e", status="DUPLICATE"), entry("t", 9, transfer=True, status="TRANSFER"), entry("i", 40, "INCOME")]
    got = {r["txn_id"]: float(r["net"]) for r in A.netted(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == {"e": 70.0, "f": 0.0, "i": 40.0}
    report = A.monthly_report(spark.createDataFrame(rows, LEDGER), "2024-03").first()
    assert (float(report["income"]), float(report["expense"]), float(report["spent"])) == (40.0, 70.0, 70.0)


@pytest.mark.parametrize("gap, label", [(7, "Weekly"), (14, "Biweekly"), (30, "Monthly"), (90, "Quarterly"), (4, None), (96, None)])
def test_recurring_labels(spark, gap, label):
    rows = [(str(k), 1, date(2023, 1, 1) + timedelta(days=gap * k), "x", "s", "c", Decimal(99), "EXPENSE", None, False, None, "OK") for k in range(4)]
    got = A.recurring(spark.createDataFrame(rows, LEDGER)).collect()
    assert [r["label"] for r in got] == ([label] if label else [])
    assert not got or got[0]["next_date"] == date(2023, 1, 1) + timedelta(days=4 * gap)


def test_irregular_uneven_or_few_charges_do_not_recur(spark):
    make = lambda days, amounts: [(str(k), 1, date(2023, 1, 1) + timedelta(days=d), "x", "s", "c", Decimal(a), "EXPENSE", None, False, None, "OK") for k, (d, a) in enumerate(zip(days, amounts))]
    for days, amounts in (((0, 30, 120), (9, 9, 9)), ((0, 30, 60), (9, 9, 90)), ((0, 30), (9, 9))):
        assert A.recurring(spark.createDataFrame(make(days, amounts), LEDGER)).count() == 0


def test_health_needs_rows_and_scores(spark):
    accounts = spark.createDataFrame([(1, 1, "SAVINGS", Decimal(600), None)], "account_key long, user_id long, account_type string, balance decimal(14,2), credit_limit decimal(14,2)")
    rows = [entry(f"{k}{kind}", 100 if kind == "EXPENSE" else 200, kind, f"2024-0{k}") for k in range(1, 6) for kind in ("EXPENSE", "INCOME")]
    got = A.health(spark.createDataFrame(rows, LEDGER), accounts).first()
    assert (got["savings"], got["debt"], got["emergency"], got["consistency"], got["cash_flow"]) == (100.0, 100.0, 100.0, 100.0, 100.0) and got["score"] == 100
    assert A.health(spark.createDataFrame(rows[:9], LEDGER), accounts).count() == 0


def test_transfers_in_order_and_in_rounds_are_the_same(spark):
    import random

    rng = random.Random(9)
    rows = []
    for user in range(3):
        days = {f"{user}r{k}": rng.randint(0, 40 if user else 400) for k in range(60)}
        ids = sorted(days)
        for _ in range(200):
            a, b = rng.sample(ids, 2)
            if abs(days[a] - days[b]) <= 10:
                rows.append((user, a, b, date(2024, 1, 1) + timedelta(days=days[a]), date(2024, 1, 1) + timedelta(days=days[b])))
    pairs = spark.createDataFrame(rows, "user_id long, a_id string, b_id string, a_date date, b_date date")
    used, want = set(), set()
    for _, a, b, *_ in sorted(rows, key=lambda r: (r[3], r[1], r[4], r[2])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    for most in (10**6, 0, 40):
        assert {tuple(r) for r in R.transfers(pairs, most).collect()} == want and want
    assert R.transfers(pairs.limit(0)).collect() == []
