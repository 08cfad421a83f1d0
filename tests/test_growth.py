"""What keeps the work of large ledgers in proportion: shuffles of whole rows, nulls that don't meet, rows that are read once."""

import re

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import folds, reconcile, rerun, verify
from ledgerloom.plans import enrich, ingest
from ledgerloom.plans import verify as checks
from ledgerloom.sources import labels, receipts, statements, tables, views


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_without_a_pointer_do_not_meet_in_one_task(spark):
    rows = spark.createDataFrame([("a", None, None, "OK"), ("b", "g", None, "DUPLICATE"), ("c", None, "g", "REFUND"), ("g", None, None, "OK")], "txn_id string, duplicate_of string, refund_of string, status string")
    found = reconcile.reset_pointers(rows, rows.where("txn_id = 'g'"))
    assert sorted(r["txn_id"] for r in found.collect()) == ["b", "c"]
    assert "isnotnull(coalesce(duplicate_of" in optimized(found)


def test_the_ledger_shuffles_its_rows_once(spark):
    plan = views.Book(spark, "/root/testdata/sf0.001").ledger._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_marks_read_the_rows_once(spark):
    rows = spark.range(8).select(
        F.concat(F.lit("t"), F.col("id")).alias("txn_id"), (F.col("id") % 2).alias("user_id"), (F.col("id") % 4).alias("account_id"), F.lit("2020-01-01").cast("date").alias("txn_date"), F.lit(5).cast("decimal(14,2)").alias("amount"),
        F.lit("EXPENSE").alias("txn_type"), F.lit("shop").alias("description"), F.lit("shop").alias("merchant"), F.lit("2020-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("confirmed_at"),
    )
    marks = rerun.marks(rows)
    assert "Range" not in optimized(marks)
    assert {r["txn_id"]: r["duplicate_of"] for r in marks.collect() if r["duplicate_of"]} == {f"t{k}": f"t{k - 4}" for k in range(4, 8)}


def test_salary_is_told_without_the_other_categories(spark):
    said = [(t,) for t in ("SALARY may", "my stipend", "income-tax refund", "salaryman", "card payment", "house rent salary", "", None)]
    rows = spark.createDataFrame(said, "t string").select(text.is_salary(text.normalize(F.col("t"))).alias("one"), (text.keyword_category(F.col("t")) == "Salary").alias("all"))
    assert all(r["one"] == r["all"] for r in rows.collect())
    ledger = spark.createDataFrame([], "txn_id string, user_id long, account_id long, txn_date date, amount decimal(14,2), txn_type string, description string")
    assert "bigbasket" not in reconcile.transfer_candidates(ledger).select("a_id")._jdf.queryExecution().logical().toString()


def test_files_are_staged_in_one_pass_and_each_row_is_read_once(spark):
    files = spark.createDataFrame([("a", 'My "Bank"\nDate of print,x\nTxn Date,Note,Note,Amount\n\n01/02/2024,"p ""q"", r",,"1,5.00 CR"\n02/02/2024,,b\n'), ("b", "no,header\n1,2"), ("c", "Date,Amount\r\n2024-01-01,(3)\r\nDate,Amount\n"), ("d", None), ("e", "")], "file string, value string")
    lines = statements.split_lines(files)
    whole, apart = statements.file_rows(files), statements.zip_rows(lines, statements.header_rows(lines))
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))
    assert [r["raw"] for r in whole.where("file = 'a'").orderBy("line_no").collect()] == [{"txn date": "01/02/2024", "note": 'p "q", r', "amount": "1,5.00 CR"}, {"txn date": "02/02/2024", "note": "b", "amount": None}]
    kept = optimized(statements.stage(whole).where("outcome = 'STAGED'"))
    assert "Join" not in kept and "Aggregate" not in kept
    # a condition on the outcome is not moved below the step that reads the fields
    assert kept.count("gettimestamp(") == len(statements.DATE_FORMATS)
    assert optimized(whole).count("posting date|date") == 1


def test_dates_and_numbers_by_a_look_first(spark):
    said = ["1st-Jan-24", "1st Jan 2024", "05Jan2024", "Jan5,2024", "12", "x1y2", "01/02/24 10:22", " 2024-01-05T10:00:00 ", "31/02/2024", "٠١/٠٢/٢٠٢٤", "", None, "1e3", "-", "Rs. 5 Dr", "(1,2.50)", "EE", "+7", "5 CR.", "12B", "n/a", "0 dr"]
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", statements.parse_date(F.col("t")).cast("string").alias("d"), statements.parse_number(F.col("t")).cast("double").alias("n")).collect()
    assert {r["t"]: r["d"] for r in rows if r["d"]} == {"1st-Jan-24": "2024-01-01", "1st Jan 2024": "2024-01-01", "05Jan2024": "2024-01-05", "Jan5,2024": "2024-01-05", "01/02/24 10:22": "2024-02-01", " 2024-01-05T10:00:00 ": "2024-01-05"}
    assert {r["t"]: r["n"] for r in rows if r["n"] is not None} == {"12": 12.0, "1e3": 1000.0, "Rs. 5 Dr": -5.0, "(1,2.50)": -12.5, "+7": 7.0, "5 CR.": 5.0, "0 dr": 0.0}


def test_folds_read_lists_as_arrays():
    for kind, values in ((pa.list_(pa.float64()), [[1.5, None], [], None, [2.0]]), (pa.list_(pa.string()), [["a", None], None, []]), (pa.list_(pa.bool_()), [[True], [False, True]]), (pa.int64(), [1, None]), (pa.int64(), [1, 2]), (pa.bool_(), [True, False]), (pa.date32(), [None]), (pa.list_(pa.list_(pa.int32())), [[[1], []], []])):
        column = pa.array(values, kind)
        assert folds.plain_list(column) == values and folds.plain_list(column[1:]) == values[1:]
    assert type(folds.plain_list(pa.array([1, 2]))[0]) is int


def test_lines_are_told_by_their_words_as_by_the_patterns():
    said = ["End of Statement", "END OF STATEMENT", "End of ſtatement", "Page 1 of 2", "page no. 7", "Savings Account - 00001234", "DEPOSIT - 5 12345", "İFSC account no: 12345", "A/C No 123456", "acc", "Total purchase & other charges", "01/02/2024", "", "most important terms and conditions"]
    for line in said:
        row = tables._Row((1, 0, 0, 1.0, [0.0], [1.0], [line], [False], [False]))
        assert [row.closing, row.banner, row.identity, row.footer] == [p.search(line) is not None for p in (tables.CLOSING, tables.BANNER, tables.IDENTITY, tables.FOOTER)], line
    # a plain line meets no pattern and no name of a header
    assert tables._header_at(tables._Row((1, 0, 0, 1.0, [0.0], [1.0], ["Description Amount"], [False], [False])), []) is None


def test_identifiers_meet_texts_that_are_normalised_already(spark):
    plan = optimized(enrich.j11(views.Book(spark, "/root/testdata/sf0.001")))
    assert "Contains(norm#" in plan


def test_text_functions_read_a_long_text_once(spark):
    codes = " ".join(f"ab{k}" for k in range(1000, 1040))
    said = [None, "", "  ", "UPI/Rent-PAID é may", f"{codes} x Big  Store no 7", f"{codes}", "a b c d eight", "neft upi x", "to pos atm " * 9 + "shop", "xgift gifts", "home loan emi", "\u00a0gift\n", "ngo donation credit card payment", "Re-turned", "x Refunded", "premium payment salary", "1mg", "neft to", "x " * 40]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    old = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))
    for t, norm, plain, merchant, token, word, refund in rows.select("t", text.normalize(F.col("t")), old, text.extract_merchant(F.col("t")), text.significant_token(F.col("t")), text.keyword_category(F.col("t")), text.mentions_refund(F.col("t"))).collect():
        words = norm.split()
        rest = [w for w in words if not re.fullmatch("[a-z]*[0-9]{4,}[a-z]*", w)]
        named = [w for w in words if w not in text.RAIL_TOKENS]
        assert norm == plain, t
        assert merchant == (" ".join(w for w in rest[:4] if len(w) > 1) or " ".join(rest) or "unknown"), t
        assert token == next((w for w in named if len(w) > 2), named[0] if named else None), t
        assert word == next((c for c, ks in text.CATEGORY_KEYWORDS if any(f" {k} " in f" {norm} " for k in ks)), "Other"), t
        assert refund == any(w in norm for w in text.REFUND_WORDS), t
    # one search finds all categories' keywords, and what is read of a text is normalised once
    plan = optimized(enrich.f_text(views.Book(spark, "/root/testdata/sf0.001")))
    assert plan.count("regexp_extract_all(") == 1 and plan.count("regexp_replace(") == 1
    assert plan.count("lower(") == 1


def test_merchants_are_made_of_descriptions_normalised_once(spark):
    rows = spark.createDataFrame([(1, "2024-01-02", "b", "UPI Corner shop 12345"), (1, "2024-01-01", "a", "corner SHOP-x"), (1, "2024-01-03", "c", "upi neft"), (2, "2024-01-01", "d", None)], "user_id long, txn_date string, txn_id string, description string")
    made = enrich.N.create_merchants(rows)
    assert sorted(map(tuple, made.collect())) == [(1, "=upi neft", "Upi Neft", 1, 1), (1, "corner", "Corner Shop", 2, 2), (2, "=", "Unknown", 1, 1)]
    assert optimized(made).count("regexp_replace(") == 1


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fields_are_found_without_dealing_a_row_for_each_field(spark):
    runs = [(1, 0, 40.0, 40.0, 60.0, "Name :"), (1, 0, 220.0, 40.0, 60.0, "A Person"), (1, 0, 40.0, 60.0, 60.0, "Closing Balance"), (1, 0, 45.0, 74.0, 60.0, "x"), (1, 0, 40.0, 88.0, 60.0, "Rs. 7"), (1, 0, 300.0, 88.0, 60.0, "IFSC"), (1, 0, 40.0, 100.0, 60.0, "IFSC: ABCD0123456"), (1, 0, 40.0, 120.0, 60.0, "Account No: 12"), (1, 0, 40.0, 140.0, 60.0, "Card No: XX-9876"), (2, 0, 40.0, 40.0, 60.0, "Branch"), (3, 0, 40.0, 40.0, 60.0, "plain")]
    found = labels.fields(tables.physical_rows(spark.createDataFrame(runs, "doc_id long, page long, x double, y double, width double, text string")))
    assert [(r["doc_id"], r["holder"], r["last4"], r["branch"], r["ifsc"], float(r["closing"])) for r in found.collect()] == [(1, "A Person", "9876", None, "ABCD0123456", 7.0)]
    assert "Union" not in executed(found)


def test_runs_meet_their_anchors_as_an_array(spark):
    runs = spark.createDataFrame([(1, 0, 12.5, 1, "a"), (1, 0, 12.5, 1, "a"), (1, 0, None, 2, None), (1, 1, 5.0, 1, "b"), (2, 0, 99.0, 1, "c"), (None, 0, 1.0, 1, "d")], "doc_id long, page int, x double, y long, text string")
    anchors = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 20.0), (2, 0, 0, 5.0), (2, 0, 1, 20.0), (None, 0, 0, 5.0)], "doc_id long, page int, column int, anchor_x double")
    found = statements.bucket_cells(runs, anchors)
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 0, 12.5, 1, "a", 0), (1, 0, None, 2, None, 0), (2, 0, 99.0, 1, "c", 1)]
    assert "SortAggregate" not in executed(found)


def test_messages_are_not_dealt_by_domain(spark):
    messages = spark.range(4).select(F.col("id").alias("message_id"), F.lit("amazon.in").alias("domain"), F.lit("Order # &AMP; <b style='DISPLAY:NONE'>Order Total 1.00</b> Order Total &lt;2.00").alias("html"))
    assert "hashpartitioning(domain" not in executed(receipts.parse(messages, receipts.stored(spark), "2024-12-31")).split("BroadcastExchange")[0]
    said = ["a&nbsp;b", "<p>x</p>y", "&amp;lt;", "<b STYLE='display : None'>z</b>w", "none", None, "<!-- & -->q", "<STYLE>x</STYLE>&lt;b>"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(receipts.plain(F.col("t"))).collect()] == ["a b", "x y", "&lt;", "w", "none", None, "q", "<b>"]


def test_statements_are_read_and_dealt_once_for_all_findings(spark):
    book = views.Book(spark, "/root/testdata/sf0.001")
    plan = executed(checks.v9(book))
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning(") == 1
    apart = checks.v1(book).select("statement_id", "verdict").union(checks.v3(book).select("statement_id", "verdict")).union(checks.v4(book).select("statement_id", "verdict"))
    assert sorted(map(tuple, checks.v9(book).collect())) == sorted(map(tuple, verify.reliability(apart).collect()))


def test_documents_are_dealt_once_and_read_by_both_folds(spark):
    book = views.Book(spark, "/root/testdata/sf0.001")
    for query in (ingest.s16_tables(book), ingest.s16_evidence(book)):
        found = executed(query).split("MapInArrow")
        assert found[1].count("Exchange") - found[1].count("BroadcastExchange") == 1 and "Union" not in found[1] and len(found) == 2
    # what numbers a document's rows is no shuffle after the folds
    assert "Exchange" not in executed(ingest.s16_tables(book)).split("MapInArrow")[0]


def test_rows_go_from_fold_to_fold_as_they_would_through_a_shuffle(spark):
    positioned = ingest._positioned(views.Book(spark, "/root/testdata/sf0.001"))
    # runs of one document in many partitions, and some that belong to none
    runs = positioned.where("doc_id % 5 = 0").union(positioned.limit(3).selectExpr("cast(null as long)", "page", "x", "width", "y", "text")).repartition(7)
    apart, at_once = tables.located(tables.physical_rows(runs)), tables.located_in(runs)
    want = sorted(map(str, apart.collect()))
    assert len(want) > 1000 and sorted(map(str, at_once.collect())) == want
    numbered = at_once.where("kind = 'ROW'").select("doc_id", "row_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("k"))
    assert numbered.where("row_no != k").head() is None and at_once.where("kind != 'ROW' and row_no is not null").head() is None
