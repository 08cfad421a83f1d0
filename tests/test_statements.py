"""Statement ingestion, verification, rules and layouts on small inputs."""

from datetime import date
from decimal import Decimal
from types import SimpleNamespace

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import enrich, layouts, platform, verify
from ledgerloom.plans import ingest
from ledgerloom.sources import sinks, statements

CSV = 'My Bank\nName: A B\nAccount No: XX9876\nTxn Date,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n01/02/2024,"Shop, one",100.00,0.00,900.00\n02/02/2024,Pay in,,"1,250.50","2,150.50"\n,No date,5.00,,\n03/02/2024,Opening Balance,,,900.00\n04/02/2024,No amount,,,\n'


def staged(spark, body=CSV):
    lines = statements.split_lines(spark.createDataFrame([("f", body)], "file string, value string"))
    return statements.stage(statements.zip_rows(lines, statements.header_rows(lines))).orderBy("line_no").collect()


def test_rows_are_staged_marked_or_explained(spark):
    rows = staged(spark)
    assert [r["outcome"] for r in rows] == ["STAGED", "STAGED", "UNPARSEABLE", "MARKER", "UNPARSEABLE"]
    assert [r["reason"] for r in rows] == [None, None, "NO_DATE", None, "NO_AMOUNT"]
    assert rows[0]["description"] == "Shop, one" and rows[0]["txn_date"] == date(2024, 2, 1) and rows[0]["txn_type"] == "EXPENSE" and rows[0]["amount"] == Decimal("100.00")
    assert rows[1]["txn_type"] == "INCOME" and rows[1]["amount"] == Decimal("1250.50") and rows[1]["balance"] == Decimal("2150.50")


def test_file_without_header_has_no_rows(spark):
    assert staged(spark, "just,some\ntext,here\n") == []


def test_csv_files_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    assert statements.header_rows(statements.read_lines(spark, str(tmp_path))).first()["header_line"] == 3


def test_dates_and_numbers(spark):
    forms = {"2024-02-01": "2024-02-01", "01/02/2024": "2024-02-01", "1st Feb 2024": "2024-02-01", "01-Feb-24": "2024-02-01", "01FEB2024 10:00": None, "01Feb2024": "2024-02-01", "02/25/2024": "2024-02-25", "x": None, "": None}
    got = spark.createDataFrame([(k,) for k in forms], "t string").select("t", F.date_format(statements.parse_date(F.col("t")), "yyyy-MM-dd").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got if r["t"] != "01FEB2024 10:00"} == {k: v for k, v in forms.items() if k != "01FEB2024 10:00"}
    numbers = {"Rs. 1,000.50": 1000.5, "(5.00)": -5.0, "7 DR": -7.0, "7.25Cr": 7.25, "-": None, " ": None, "₹9": 9.0}
    got = spark.createDataFrame([(k,) for k in numbers], "t string").select("t", statements.parse_number(F.col("t")).cast("double").alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == numbers


def chain(spark, rows, opening=100):
    frame = spark.createDataFrame([("s", k, date(2024, 1, d), None if a is None else Decimal(a), None if b is None else Decimal(b)) for k, (d, a, b) in enumerate(rows)], "statement_id string, row_no int, txn_date date, amount decimal(24,2), balance decimal(24,2)")
    openings = spark.createDataFrame([("s", None if opening is None else Decimal(opening))], "statement_id string, opening decimal(24,2)")
    r = verify.balance_chain(frame, openings).first()
    return r["pairs"], r["off"], r["verdict"]


def test_balance_chain(spark):
    assert chain(spark, [(1, 10, 110), (2, -20, 90), (3, 5, 95)]) == (3, 0, "VERIFIED")
    assert chain(spark, [(3, 5, 95), (2, -20, 90), (1, 10, 110)]) == (3, 0, "VERIFIED")
    assert chain(spark, [(1, 10, 111), (2, -20, 91), (3, 5, 96)]) == (3, 1, "WARNING")
    assert chain(spark, [(1, 10, 111), (2, -20, 99), (3, 5, 104)]) == (3, 2, "FAILED")
    assert chain(spark, [(1, 10, None), (2, -20, 90), (3, None, None), (4, 5, 7), (5, 1, 8)]) == (2, 0, "VERIFIED")
    assert chain(spark, [(1, 10, 110)]) == (1, 0, "NOT_APPLICABLE")
    assert chain(spark, [(1, 10, 110), (2, 1, 111), (3, 1, 112)], None) == (2, 0, "VERIFIED")


def test_closing_guard_and_reliability(spark):
    rows = [("a", Decimal(100), Decimal(130), Decimal(50), Decimal(20), 3, 0, False), ("b", Decimal(100), Decimal(70), Decimal(50), Decimal(20), 3, 0, True), ("c", None, Decimal(1), Decimal(0), Decimal(0), 1, 0, False), ("d", Decimal(1), None, Decimal(0), Decimal(0), 1, 0, False)]
    frame = spark.createDataFrame(rows, "statement_id string, opening decimal(24,2), closing decimal(24,2), credits decimal(24,2), debits decimal(24,2), rows int, skipped int, liability boolean")
    got = {r[0]: r[1] for r in verify.closing_guard(frame).collect()}
    assert got == {"a": "CORROBORATED", "b": "CORROBORATED", "c": "UNCORROBORATED", "d": "NOT_APPLICABLE"}
    found = spark.createDataFrame([("a", "VERIFIED"), ("b", "WARNING"), ("b", "VERIFIED"), ("c", "WARNING"), ("c", "FAILED")], "statement_id string, verdict string")
    assert {r[0]: r[2] for r in verify.reliability(found).collect()} == {"a": "CLEAN", "b": "REVIEW_RECOMMENDED", "c": "NEEDS_ATTENTION"}


def test_rules_prefer_users_then_priority(spark):
    rules = spark.createDataFrame([(1, "GLOBAL", None, "DESCRIPTION", "CONTAINS", "SHOP", "G", "ASSIGN_CATEGORY", 1), (2, "USER", 1, "AMOUNT", "BETWEEN", "5,10", "U", "ASSIGN_CATEGORY", 9), (3, "USER", 2, "AMOUNT", "BETWEEN", "5", "X", "ASSIGN_CATEGORY", 1), (4, "GLOBAL", None, "MERCHANT", "EQUALS", "m", "t", "ADD_TAG", 1)], "rule_id int, scope string, rule_user long, field string, operator string, value string, target string, action string, priority int")
    rows = spark.createDataFrame([("a", 1, "the shop", "M", Decimal(7)), ("b", 2, "the shop", None, Decimal(7)), ("c", 1, None, "q", Decimal(70))], "txn_id string, user_id long, description string, merchant string, amount decimal(14,2)")
    matches = enrich.rule_matches(rows, rules, ["txn_id"])
    assert {r["txn_id"]: r["target"] for r in enrich.first_rule(matches).collect()} == {"a": "U", "b": "G"}
    assert [(r["txn_id"], r["tags"]) for r in enrich.side_effects(matches).collect()] == [("a", "t")]


def test_learning_replay(spark):
    log = [(1, "CONFIRM", 1), (2, "CONFIRM", 1), (3, "CONFIRM", 2), (4, "UNDO", None), (5, "UNDO", None), (6, "CONFIRM", 3), (7, "RESET", None), (8, "CONFIRM", 2)]
    events = spark.createDataFrame([(i, i, 1, "m", c, k) for i, k, c in log], "event_id long, ts long, user_id long, merchant string, category_id long, kind string")
    got = enrich.replay(events).collect()
    assert [(r["category_id"], r["confirmations"], r["learned"], r["corrected"]) for r in got] == [(2, 1, 3, 2)]


def test_text_functions(spark):
    row = spark.createDataFrame([("UPI/Big Shop-12345 pos", "a@b.c", "+91 98765", " ")], "t string, m string, p string, b string")
    got = row.select(text.normalize(F.col("t")), text.extract_merchant(F.col("t")), text.significant_token(F.col("t")), text.mask_email(F.col("m")), text.mask_phone(F.col("p")), text.mask_phone(F.col("b")), text.display_name(F.lit("mcDonald s")), text.display_name(F.col("b"))).first()
    assert list(got) == ["upi big shop 12345 pos", "upi big shop pos", "big", "a***@b.c", "+*****765", None, "McDonald S", "Unknown Merchant"]


def test_not_in_with_a_null_is_empty(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    assert platform.inactive_users(users, spark.createDataFrame([(1,), (None,)], "user_id long")).count() == 0
    assert [r[0] for r in platform.inactive_users_ignoring_nulls(users, spark.createDataFrame([(1,), (None,)], "user_id long")).collect()] == [2]


def test_pages_are_clamped(spark):
    df = spark.range(250)
    assert platform.page(df, ["id"], -3, 500).count() == 100
    assert [r[0] for r in platform.page(df, ["id"], 2, 2).collect()] == [4, 5]


def test_upserts_and_change_sets(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, layouts.latest_wins(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, layouts.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    changes = sinks.change_set(old, new, "k", ["v"])
    assert sorted(map(tuple, changes.collect())) == [(2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.apply_changes(old, changes, "k", ["v"]).collect())) == [(1, "a"), (2, "c")]
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "user_id int, v string")
    manifest = sinks.export({"t": rows}, str(tmp_path / "out"))
    assert sorted(map(tuple, manifest.collect())) == [(1, 2, "t"), (2, 1, "t")]
    assert spark.read.json(str(tmp_path / "out" / "t")).count() == 3
