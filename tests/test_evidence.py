"""Dimensions of evidence with their provenance, and the summary of analyses."""

from datetime import datetime

from ledgerloom.operators import evidence, layouts

FACTS = "claim_id long, field string, source string, value string, node string"
NODES = [("w1", "l1"), ("w2", "l1"), ("w3", "l2"), ("l1", "p1"), ("l2", "p2"), ("p1", None), ("p2", None)]


def one(spark, facts, *finance):
    rows = spark.createDataFrame([(1, *f) for f in facts], FACTS)
    check = spark.createDataFrame([(1, *f) for f in finance], "claim_id long, chain string, totals string, cause string, node string")
    found = evidence.assess(rows, spark.createDataFrame(NODES, "node string, parent string"), check).collect()
    return tuple(found[0])[1:] if found else None


def test_ancestors_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}" if k < 40 else None) for k in range(41)] + [("a", "b"), ("b", "a"), (None, "n3")], "node string, parent string")
    up = {}
    for r in evidence.ancestors(chain).collect():
        up.setdefault(r["node"], set()).add(r["up"])
    assert len(up["n0"]) == 41 and up["n40"] == {"n40"} and up["a"] == up["b"] == {"a", "b"}


def test_dimensions(spark):
    amount = lambda source, value, node: ("TRANSACTION_AMOUNT", source, value, node)
    # two lines of one page agree, but share it; of two pages they corroborate each other
    assert one(spark, [amount("ROW_DATA", "5", "w1"), amount("SECTION_TEXT", "5", "w2")]) == ("SUPPORTED", "INSUFFICIENT", "INSUFFICIENT", "INSUFFICIENT")
    assert one(spark, [amount("ROW_DATA", "5", "w1"), amount("SECTION_TEXT", "5", "w3")])[:2] == ("SUPPORTED", "SUPPORTED")
    # the strongest fact is one of all facts: with corroboration alone it is not independent, with a check from elsewhere it is
    assert one(spark, [amount("ROW_DATA", "5", "w1"), amount("SECTION_TEXT", "5", "w3")])[3] == "INSUFFICIENT"
    assert one(spark, [amount("ROW_DATA", "5", "w1")], ("HOLDS", None, None, "p2")) == ("SUPPORTED", "INSUFFICIENT", "SUPPORTED", "SUPPORTED")
    assert one(spark, [amount("ROW_DATA", "5", "w1")], ("HOLDS", None, None, "p1"))[3] == "INSUFFICIENT"
    assert one(spark, [amount("ROW_DATA", "5", "w1")], ("BROKEN", None, None, "p2"))[2:] == ("CONFLICTING", "CONFLICTING")
    assert one(spark, [amount("ROW_DATA", "5", "w1"), amount("ROW_DATA", "6", "w3")])[1::2] == ("CONFLICTING", "CONFLICTING")
    assert one(spark, [amount("ROW_DATA", None, "w1")]) is None
    opening, closing = (lambda f=f: [(f, "COLUMN_HEADERS", "5", None)] for f in ("OPENING_BALANCE", "CLOSING_BALANCE"))
    assert one(spark, opening(), (None, "FAILED", "OPENING_BALANCE", None))[2] == "CONFLICTING"
    assert one(spark, closing(), (None, "FAILED", "OPENING_BALANCE", None))[2] == "INSUFFICIENT"
    assert one(spark, closing(), (None, "VERIFIED", None, "p1")) == ("SUPPORTED", "INSUFFICIENT", "SUPPORTED", "SUPPORTED")
    assert one(spark, [("TRANSACTION_DATE", "ROW_DATA", "d", "w1")], ("HOLDS", "VERIFIED", None, "p2"))[2] == "INSUFFICIENT"


def test_summary_sets_unreadable_reasons_aside(spark):
    rows = [(k, datetime(2024, 1, 1 + k), o, lay, n, j) for k, (o, lay, n, j) in enumerate([("PARSED", "a", 5, '{"OLD":9}'), ("FAILED", None, None, "{"), ("PARSED", "b", 7, '{"X":2,"Y":1}'), ("OPEN", "b", 1, '{"X":"no"}'), ("PARSED", "b", 2, None), ("PARSED", "c", 3, '{"X":3}')])]
    found = {(r["part"], r["key"]): r["n"] for r in layouts.analysis_summary(spark.createDataFrame(rows, "session_id long, at timestamp, outcome string, layout string, rows long, reasons string"), 5).collect()}
    assert found == {("ALL", "sessions"): 6, ("ALL", "PARSED"): 4, ("ALL", "FAILED"): 1, ("ALL", "layouts"): 3, ("RECENT", "sessions"): 5, ("RECENT", "rows"): 13, ("RECENT", "unanchored"): 6, ("RECENT", "unreadable"): 2, ("REASON", "X"): 5, ("REASON", "Y"): 1}
    empty = layouts.analysis_summary(spark.createDataFrame([], "session_id long, at timestamp, outcome string, layout string, rows long, reasons string"), 5)
    assert {r["n"] for r in empty.collect()} == {0}
