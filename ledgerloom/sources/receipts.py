"""Receipts in merchants' e-mails, by stored templates: label and value cells, line items, patterns in the text.

A template is a row, so merchants are added without code; messages meet theirs by an equi-join on the sender's domain. All of it is
Column expressions over a message's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statements import once, parse_date, parse_number

#: marker, stop: patterns that a receipt's text has and must not have. amount, date: the label cell's pattern, or a pattern
#: of the text with the value as its first group. items: rows of a name and an amount in front of the total add up to it.
TEMPLATE = "domain string, marker string, stop string, amount_label string, date_label string, amount_pattern string, date_pattern string, items boolean"
# Seven merchants' shapes.
_MONEY = r"\s*:?\s*(?:₹|Rs\.?|INR)?\s*(?<!\d)([\d,]{1,18}\.\d{2})(?!\d)"
_DAY = r"\s*:?\s*([A-Za-z]+ \d{1,2}, \d{4}|\d{1,2} [A-Za-z]{3} \d{4}|\d{4}-\d{2}-\d{2})"
TEMPLATES = [
    ("amazon.in", r"Order\s*#", None, None, None, f"(?i)(?:Order Total|Grand Total){_MONEY}", f"Order Date{_DAY}", False),
    ("booking.com", "Booking Confirmed", "(?i)Pay at the property|No prepayment needed", None, None, f"(?i)Amount Charged{_MONEY}", f"Booked on{_DAY}", False),
    ("olacabs.com", r"Ride\s*Bill", None, None, None, f"(?i)Total Fare{_MONEY}", f"Ride Date{_DAY}", False),
    ("myntra.com", "Order Confirmed", "(?i)Return Initiated|Refund Processed|Exchange Confirmed", None, None, f"(?i)Order Total{_MONEY}", f"Order Date{_DAY}", False),
    ("food.example", "(?i)thanks for ordering", "(?i)cancelled", "(?i)^(?:grand )?total$", "(?i)^ordered on$", None, None, True),
    ("grocer.example", "(?i)tax invoice", "(?i)credit note", "(?i)^amount payable$", "(?i)^invoice date$", None, None, True),
    ("stream.example", "(?i)your receipt", "(?i)free trial", "(?i)^total$", None, None, f"(?i)billed on{_DAY}", False),
]


#: Messages that one task reads; they are counted once for the number of parts.
PART_MESSAGES = 50_000


def plain(html: Column) -> Column:
    """The visible text of markup: no scripts, styles, comments or hidden elements, entities decoded, one space between words."""
    def bare(text: Column) -> Column:
        text = F.regexp_replace(text, r"(?is)<(script|style|head|template)\b.*?</\1\s*>|<!--.*?-->", " ")
        shown = lambda t: F.regexp_replace(t, r"(?is)<(\w+)[^>]*\bstyle\s*=\s*[\"'][^\"'>]*display\s*:\s*none[^>]*>.*?</\1\s*>", " ")
        text = once(text, lambda t: F.when(F.lower(t).contains("none"), shown(t)).otherwise(t))
        return F.regexp_replace(text, r"(?s)<[^>]*>", " ")

    def decoded(text: Column) -> Column:
        for entity, sign in ((r"&nbsp;|&#160;", " "), (r"&#8377;|&#x20[bB]9;", "₹"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&")):
            text = F.regexp_replace(text, entity, sign)
        return text

    # most cells hold no tag, and most texts no entity: a look for their first sign costs far less than the patterns
    text = once(html, lambda t: F.when(t.contains("<"), bare(t)).otherwise(t))
    text = once(text, lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cells(html: Column) -> Column:
    """The texts of the cells of each table row, rows of inner tables included."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>((?:(?!<tr\b|</tr).)*+)"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>((?:(?!<t[dh]\b|</t[dh]).)*+)"), F.lit(1)), plain))


def parse(messages: DataFrame, templates: DataFrame, as_of: str) -> DataFrame:
    """message_id, domain, status, reason, amount, day, n_items and violations of every message (message_id, domain, html).

    NOT_A_RECEIPT: no template for the domain (NO_TEMPLATE), its stop pattern was met (STOP), or its marker wasn't (NO_MARKER). MALFORMED: an amount or a
    date isn't found or can't be read. Else PARSED, with violations: AMOUNT_NOT_POSITIVE, DATE_IN_FUTURE (after ``as_of``), ITEMS_DIFFER.
    Null html is an empty text. A domain has one template; of several the first by its marker counts.
    """
    chosen = templates.groupBy("domain").agg(F.min_by(F.struct(*[c for c in templates.columns if c != "domain"]), F.coalesce("marker", F.lit(""))).alias("t")).select("domain", "t.*")
    # templates are a row a merchant and go to the messages: dealt by domain, all messages of one merchant would be one task's.
    # within a task they come by domain, so a template's patterns are compiled once and not for each message
    dealt = messages.select("message_id", "domain", F.coalesce("html", F.lit("")).alias("html")).repartition(max(1, -(-messages.count() // PART_MESSAGES)), "message_id")
    rows = dealt.join(F.broadcast(chosen.withColumn("known", F.lit(True))), "domain", "left").sortWithinPartitions("domain")
    rows = rows.withColumn("text", plain(F.col("html"))).withColumn("cells", F.when(F.col("amount_label").isNotNull() | F.col("date_label").isNotNull(), cells(F.col("html"))))
    in_cell = lambda label: f"get(filter(transform(cells, r -> get(transform(filter(sequence(0, greatest(size(r) - 2, 0)), i -> get(r, i) rlike {label}), i -> get(r, i + 1)), 0)), v -> v is not null), 0)"
    found = lambda kind: F.coalesce(F.expr(f"case when {kind}_label is not null then {in_cell(f'{kind}_label')} end"), F.expr(f"case when {kind}_pattern is not null then nullif(regexp_extract(text, {kind}_pattern, 1), '') end"))
    rows = rows.withColumn("said_amount", found("amount")).withColumn("said_day", found("date"))
    rows = rows.withColumn("amount", parse_number(F.regexp_replace("said_amount", "^[^0-9(-]*", ""))).withColumn("day", parse_date(F.col("said_day")))
    # in front of the total: rows that end in an amount and aren't the total's own or a date's
    before = "slice(cells, 1, coalesce(nullif(array_position(transform(cells, r -> exists(r, c -> c rlike amount_label)), true), 0) - 1, size(cells)))"
    item = F.expr(f"case when items and amount_label is not null then filter({before}, r -> size(r) >= 2 and element_at(r, -1) rlike '(?i)^(?:rs[.]?|inr|[^0-9a-z])*[0-9][0-9,]*[.][0-9]{{2}}$') end")
    rows = rows.withColumn("items_found", item)
    total = F.aggregate(F.transform("items_found", lambda r: F.coalesce(parse_number(F.regexp_replace(F.element_at(r, -1), "^[^0-9]*", "")), F.lit(0)).cast("decimal(24,2)")), F.lit(0).cast("decimal(24,2)"), lambda a, x: (a + x).cast("decimal(24,2)"))
    lost = F.when(F.col("known").isNull(), "NO_TEMPLATE").when(F.expr("stop is not null and text rlike stop"), "STOP").when(F.expr("not coalesce(text rlike marker, false)"), "NO_MARKER")
    broken = F.when(F.col("said_amount").isNull(), "AMOUNT_NOT_FOUND").when(F.col("amount").isNull(), "AMOUNT_UNREADABLE").when(F.col("said_day").isNull(), "DATE_NOT_FOUND").when(F.col("day").isNull(), "DATE_UNREADABLE")
    parsed = lost.isNull() & broken.isNull()
    against = F.array_compact(F.array(F.when(F.col("amount") <= 0, "AMOUNT_NOT_POSITIVE"), F.when(F.col("day") > F.lit(as_of).cast("date"), "DATE_IN_FUTURE"), F.when((F.size("items_found") > 0) & (total != F.col("amount")), "ITEMS_DIFFER")))
    only = lambda c: F.when(parsed, c)
    return rows.select("message_id", "domain", F.when(lost.isNotNull(), "NOT_A_RECEIPT").when(broken.isNotNull(), "MALFORMED").otherwise("PARSED").alias("status"), F.coalesce(lost, broken).alias("reason"), only(F.col("amount")).alias("amount"), only(F.col("day")).alias("day"), only(F.when(F.col("items_found").isNotNull(), F.size("items_found")).otherwise(0)).alias("n_items"), only(against).alias("violations"))


def stored(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, TEMPLATE)


def try_template(samples: DataFrame, template: tuple, as_of: str) -> DataFrame:
    """What a template that isn't stored yet would make of sample messages (message_id, html), as ``parse`` gives it.

    A pattern that doesn't compile raises here, before it is stored.
    """
    spark = samples.sparkSession
    probe = spark.createDataFrame([template], TEMPLATE)
    checks = [F.lit("").rlike(p) for p in template[1:7] if p is not None]
    spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(checks)]).collect()
    return parse(samples.withColumn("domain", F.lit(template[0])), probe, as_of)
