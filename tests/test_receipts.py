"""Receipts by templates: cells, patterns, items, statuses and violations."""

import pytest

from ledgerloom.sources import receipts


def parsed(spark, domain, html, templates=None):
    rows = spark.createDataFrame([(1, domain, html)], "message_id long, domain string, html string")
    r = receipts.parse(rows, templates if templates is not None else receipts.stored(spark), "2024-12-31").first()
    return r["status"], r["reason"], None if r["amount"] is None else float(r["amount"]), None if r["day"] is None else str(r["day"]), r["n_items"], r["violations"]


def test_patterns_see_the_visible_text_only(spark):
    html = "<head><title>Order Total 9.00</title></head><!-- Order Total 8.00 --><script>Order Total 7.00</script><p style='color:red; DISPLAY: none'>Order Total 6.00</p>Order <b>#</b>5 Grand&nbsp;Total: &#8377;1,234.50 Order Date: March 5, 2024"
    assert parsed(spark, "amazon.in", html) == ("PARSED", None, 1234.5, "2024-03-05", 0, [])
    assert parsed(spark, "amazon.in", "Order Total 5.00 Order Date 2024-03-05")[:2] == ("NOT_A_RECEIPT", "NO_MARKER")
    assert parsed(spark, "amazon.in", "Order # 1 Order Total 5 Order Date 2024-03-05")[:2] == ("MALFORMED", "AMOUNT_NOT_FOUND")
    assert parsed(spark, "amazon.in", "Order # 1 Order Total 5.00 Order Date 2024-03-99")[:2] == ("MALFORMED", "DATE_UNREADABLE")
    assert parsed(spark, "amazon.in", None)[:2] == ("NOT_A_RECEIPT", "NO_MARKER")
    assert parsed(spark, "nobody.example", html)[:2] == parsed(spark, None, html)[:2] == ("NOT_A_RECEIPT", "NO_TEMPLATE")


def test_label_cells_items_and_violations(spark):
    page = lambda soup, total, day: f"Thanks for ordering<table><tr><td><table><tr><th>Dish</th><th>Price</th></tr><tr><td>Soup</td><td> Rs. {soup}</td></tr><tr><td>2 x Rice</td><td></td><td>₹5.50</td></tr><tr><td>Grand  Total</td><td>₹ {total}</td></tr></table></td></tr><tr><td>Ordered on<td>{day}</table>"
    assert parsed(spark, "food.example", page("4.50", "10.00", "5 Mar 2024")) == ("PARSED", None, 10.0, "2024-03-05", 2, [])
    assert parsed(spark, "food.example", page("4.00", "10.00", "5 Mar 2025"))[5] == ["DATE_IN_FUTURE", "ITEMS_DIFFER"]
    assert parsed(spark, "food.example", page("4.50", "-", "5 Mar 2024"))[:2] == ("MALFORMED", "AMOUNT_UNREADABLE")
    assert parsed(spark, "food.example", page("4.50", "10.00", "5 Mar 2024") + " Cancelled")[:2] == ("NOT_A_RECEIPT", "STOP")
    assert parsed(spark, "food.example", "Thanks for ordering")[:2] == ("MALFORMED", "AMOUNT_NOT_FOUND")


def test_a_template_is_tried_before_it_is_stored(spark):
    samples = spark.createDataFrame([(1, "Bill Sum 3.00 on 2024-01-02"), (2, "hello"), (3, "Bill Sum 0.00 on 2024-01-02")], "message_id long, html string")
    template = ("new.example", "Bill", None, None, None, r"Sum ([0-9.]+)", r"on (\S+)", False)
    got = {r["message_id"]: (r["status"], r["violations"]) for r in receipts.try_template(samples, template, "2024-12-31").collect()}
    assert got == {1: ("PARSED", []), 2: ("NOT_A_RECEIPT", None), 3: ("PARSED", ["AMOUNT_NOT_POSITIVE"])}
    with pytest.raises(Exception, match="(?i)regex|pattern"):
        receipts.try_template(samples, ("new.example", "(", None, None, None, "x", "y", False), "2024-12-31")
