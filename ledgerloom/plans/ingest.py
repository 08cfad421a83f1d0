"""Queries of statement ingestion: files are built from the ledger, one for each account."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import labels, receipts, records, sinks, statements, tables
from ..sources import views as V


def _files(b):
    """CSV texts with a preamble, a header and rows whose dates and amounts are written in several ways."""
    day = F.when(F.col("qty") % 3 == 0, F.date_format("txn_date", "dd/MM/yyyy")).when(F.col("qty") % 3 == 1, F.date_format("txn_date", "yyyy-MM-dd")).otherwise(F.date_format("txn_date", "dd-MMM-yyyy"))
    money = F.col("amount").cast("string")
    amount = F.when(F.col("qty") == 50, F.lit("n/a")).when(F.col("txn_type") == "INCOME", F.concat(money, F.lit(" CR"))).when(F.col("tax") > 4, F.concat(F.lit("("), money, F.lit(")"))).otherwise(F.concat(F.lit("Rs. "), money))
    line = F.concat_ws(",", day, F.when(F.col("qty") == 49, F.lit("Opening Balance")).otherwise(F.concat(F.lit('"'), "description", F.lit(', x"'))), amount, F.col("txn_id"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("txn_date", "txn_id", line.alias("line")))), lambda r: r["line"]), "\n")
    rows = b.base.groupBy("account_id").agg(body.alias("body"))
    return rows.select(F.col("account_id").cast("string").alias("file"), F.concat(F.lit("Statement\nName: A Holder\nAccount No: XXXX1234\n\nTxn Date,Narration,Amount (INR),Ref No.\n"), "body").alias("value"))


def _staged(b):
    return statements.stage(statements.file_rows(_files(b)))


def s11(b):
    return _staged(b).where("outcome = 'STAGED'").select("reference", F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"), F.col("amount").cast("double").alias("amount"), "txn_type", "description")


def s13(b):
    return _staged(b).groupBy("file", "outcome").agg(F.count("*").alias("rows"))


def s14(b):
    return statements.reject_summary(_staged(b))


def s2(b):
    return statements.header_rows(statements.split_lines(_files(b))).select("file", "header_line", F.array_join("names", "|").alias("names"))


def s17(b):
    return statements.metadata(statements.split_lines(_files(b))).select("file", "holder", "last4")


def j14(b):
    ledger = b.base.where("qty < 25").select("txn_date", "amount", F.concat("description", F.lit(", x")).alias("description"))
    return statements.mark_duplicates(_staged(b).where("outcome = 'STAGED'"), ledger).select("reference", "matches")


def _csv_lines(b):
    """A file for each account and year, as lines in blocks of seven: descriptions with line breaks, blank lines, commas and quotes inside quotes, and bad rows."""
    d = b.base.withColumn("file", F.concat_ws("-", "account_id", F.year("txn_date")))
    order = Window.partitionBy("file").orderBy("txn_date", "txn_id")
    kind = F.col("qty") % 7
    said = F.when(kind == 0, F.concat(F.lit('"'), F.replace("description", F.lit(" "), F.lit("\n")), F.lit('"'))).when(kind == 1, F.concat(F.lit('"'), F.replace("description", F.lit(" "), F.lit('""')), F.lit(', x"'))).when(kind == 2, F.concat(F.lit('"'), "description", F.lit('\n\n""\n"'))).when(kind == 3, F.concat("description", F.lit(' "x" '))).otherwise(F.col("description"))
    text = F.concat("txn_id", F.lit(","), said, F.lit(","), "amount", F.when(kind == 4, "\n").otherwise(""))
    last = F.lead("txn_id").over(order).isNull() & (F.col("qty") % 3 == 0)
    rows = d.select("file", "txn_date", "txn_id", F.split(F.concat(text, F.when(last, ',"open').otherwise("")), "\n").alias("parts"))
    # where each row's lines start in its file
    upto = F.sum(F.size("parts")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = rows.withColumn("upto", F.coalesce(upto, F.lit(0))).select("file", "upto", F.posexplode("parts").alias("k", "line")).withColumn("at", F.col("upto") + F.col("k"))
    return lines.select("file", F.floor(F.col("at") / 7).alias("block"), "at", "line")


def s1(b):
    return records.records(_csv_lines(b)).select("file", "record", "first_line", F.array_join("cells", "|").alias("cells"), "status")


S1_SQL = f"""WITH {V.BASE}, d AS (SELECT *, concat_ws('-', account_id, year(txn_date)) AS file, qty % 7 AS kind FROM base),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY txn_date, txn_id) - 1 AS record, lead(txn_id) OVER (PARTITION BY file ORDER BY txn_date, txn_id) IS NULL AND qty % 3 = 0 AS open,
  CASE kind WHEN 0 THEN len(string_split(description, ' ')) WHEN 2 THEN 4 WHEN 4 THEN 2 ELSE 1 END AS lines FROM d),
l AS (SELECT *, coalesce(sum(lines) OVER (PARTITION BY file ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM o),
-- an open quote behind a line break stands on the line below, which is then the record
x AS (SELECT *, CASE kind WHEN 0 THEN replace(description, ' ', chr(10)) WHEN 1 THEN replace(description, ' ', '"') || ', x' WHEN 2 THEN description || chr(10) || chr(10) || '"' || chr(10) ELSE description END AS said FROM l),
r AS (SELECT file, record, first_line, CASE WHEN kind = 3 OR (open AND kind <> 4) THEN NULL ELSE txn_id || '|' || said || '|' || amount END AS cells, CASE WHEN open AND kind <> 4 THEN 'UNTERMINATED' WHEN kind = 3 THEN 'MALFORMED' ELSE 'OK' END AS status FROM x)
SELECT file, record, CAST(first_line AS BIGINT) AS first_line, cells, status FROM r UNION ALL SELECT file, record + 1, CAST(first_line + 1 AS BIGINT), NULL, 'UNTERMINATED' FROM x WHERE open AND kind = 4"""


def s7(b):
    d = b.base
    forms = F.array(F.date_format("txn_date", "dd.MM.yyyy"), F.date_format("txn_date", "dd/MM/yy"), F.concat(F.date_format("txn_date", "dd MMM yyyy"), F.lit(" 10:22:00")), F.date_format("txn_date", "ddMMMyyyy"), F.date_format("txn_date", "MMM dd, yyyy"), F.date_format("txn_date", "MMMMd, yyyy"), F.lit("no date"))
    return d.select("txn_id", F.posexplode(forms).alias("form", "text")).select("txn_id", "form", F.date_format(statements.parse_date(F.col("text")), "yyyy-MM-dd").alias("parsed"))


def s8(b):
    forms = F.array(F.concat(F.lit("₹ "), F.col("amount").cast("string")), F.concat("amount", F.lit(" Dr")), F.concat(F.lit("INR"), "amount", F.lit("CR")), F.concat(F.lit("("), "amount", F.lit(")")), F.lit("-"), F.lit("1,234.50"), F.concat(F.lit("+"), "amount"))
    rows = b.base.select("txn_id", F.posexplode(forms).alias("form", "text"))
    return rows.select("txn_id", "form", statements.parse_number(F.col("text")).cast("double").alias("value"), statements.raw_sign(F.col("text")).alias("sign"))


def s18(b):
    templates = b.spark.createDataFrame([("order", "the", "unsubscribe", r"([0-9]+[.][0-9]{2})", r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), ("ad", "ad", "&amp;", r"([0-9]+)", r"(x)")], "template string, marker string, stop string, amount_pattern string, date_pattern string")
    return statements.receipts(b.table("pages"), templates).groupBy("template", "status").agg(F.count("*").alias("pages"), F.sum("amount").cast("double").alias("amount"))


S18_SQL = r"""WITH p AS (SELECT trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages),
r AS (SELECT 'order' AS template, contains(lower(t), 'unsubscribe') OR NOT contains(lower(t), 'the') AS no, TRY_CAST(regexp_extract(t, '([0-9]+[.][0-9]{2})', 1) AS DECIMAL(14,2)) AS a, TRY_CAST(regexp_extract(t, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS DATE) AS d FROM p
  UNION ALL SELECT 'ad', contains(lower(t), '&amp;') OR NOT contains(lower(t), 'ad'), 0, NULL FROM p),
s AS (SELECT template, CASE WHEN no THEN 'NOT_A_RECEIPT' WHEN a IS NULL OR d IS NULL THEN 'MALFORMED' ELSE 'PARSED' END AS status, a FROM r)
SELECT template, status, count(*) AS pages, CAST(sum(CASE WHEN status = 'PARSED' THEN a END) AS DOUBLE) AS amount FROM s GROUP BY 1, 2"""


def s16(b):
    """Lines as text runs: a page's heights drift by less than the tolerance, so rows depend on where the one above began."""
    item = b.table("lineitem")
    runs = item.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_discount").alias("x"), F.col("l_quantity").alias("y"), F.lit(0.0).alias("width"), F.col("l_returnflag").alias("text"))
    return tables.physical_rows(runs).select("doc_id", "page", "row_no", "y", F.array_join("texts", " ").alias("text"))


#: Transactions on a page of the statements that ``_positioned`` prints.
PAGE = 5


def _positioned(b):
    """Statements of one account and year as text runs, in four layouts by year.

    0: plain. 1: a header of two lines, descriptions wrapped over up to four. 2: the description stands above its date. 3: a banner on every page,
    a payment before the header, a closing line and a payment after it. All repeat header and footer on every page and
    print amounts flush right, wider than their headers.
    """
    year = F.year("txn_date")
    # dealt by document once: its rows are numbered and counted where they stand, and a page's first row prints the page's frame too
    rows = b.base.withColumn("doc_id", F.col("account_id") * 10000 + year).withColumn("layout", year % 4).repartition("doc_id")
    order = Window.partitionBy("doc_id").orderBy("txn_date", "txn_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("r", F.row_number().over(order) - 1).withColumn("last", F.floor((F.count("*").over(whole) - 1) / PAGE)).withColumn("page", F.floor(F.col("r") / PAGE)).withColumn("top", 130.0 + F.col("r") % PAGE * 40)
    place = lambda x, width, y, text: F.struct(F.lit(x).cast("double").alias("x"), F.lit(width).cast("double").alias("width"), F.lit(y).cast("double").alias("y"), text.alias("text"))
    run = lambda x, width, dy, text: place(x, width, F.col("top") + dy, text)
    flush = lambda right, dy, text: place(right - 12.0 * F.length(text), 12.0 * F.length(text), F.col("top") + dy, text)
    layout, money = F.col("layout"), F.col("amount").cast("string")
    spent = F.col("txn_type") == "EXPENSE"
    day = F.when(layout == 2, F.date_format("txn_date", "dd-MMM-yyyy")).when(layout == 3, F.date_format("txn_date", "yyyy-MM-dd")).otherwise(F.date_format("txn_date", "dd/MM/yyyy"))
    word, rest = F.substring_index("description", " ", 1), F.expr("substr(description, length(substring_index(description, ' ', 1)) + 2)")
    value = F.when(spent, flush(F.lit(350.0), 0, money)).otherwise(flush(F.lit(420.0), 0, money))
    printed = F.when(layout == 0, F.array(run(40, 55, 0, day), run(110, 80, 0, F.col("description")), value)).when(layout == 1, F.array(run(40, 55, 0, day), run(110, 40, 0, word), value, run(110, 60, 9, rest), run(110, 60, 18, F.col("txn_id")), run(110, 60, 27, F.lit("via mobile banking")))).when(layout == 2, F.array(run(110, 80, -5, F.col("description")), run(40, 55, 0, day), value)).otherwise(F.array(run(40, 55, 0, day), run(110, 80, 0, F.col("description")), flush(F.lit(340.0), 0, money), run(380, 12, 0, F.when(spent, "DR").otherwise("CR"))))
    none = F.array().cast("array<struct<x:double,width:double,y:double,text:string>>")
    text = lambda x, width, y, what: place(x, width, y, F.lit(what))
    plain = [text(40, 22, 100, "Date"), text(110, 55, 100, "Description"), text(300, 50, 100, "Withdrawal"), text(380, 40, 100, "Deposit")]
    wrapped = [text(40, 18, 92, "Txn"), text(110, 50, 92, "Narration"), text(300, 50, 92, "Withdrawal"), text(380, 40, 92, "Deposit"), text(40, 22, 102, "Date"), text(310, 25, 102, "(INR)"), text(390, 25, 102, "(INR)")]
    typed = [place(150, 200, 60, F.concat(F.lit("SAVINGS ACCOUNT - "), F.lpad(F.col("account_id").cast("string"), 8, "0"))), text(40, 22, 100, "Date"), text(110, 55, 100, "Particulars"), text(300, 40, 100, "Amount"), text(380, 20, 100, "Type")]
    first = F.when(F.col("page") == 0, F.array(text(110, 60, 75, "Last payment"), text(40, 55, 75, "01/02/1995"), text(300, 40, 75, "12.50"))).otherwise(none)
    ended = F.when(F.col("page") == F.col("last"), F.array(text(200, 90, 705, "End of statement"), text(40, 55, 715, "03/02/1995"), text(300, 40, 715, "99.00"))).otherwise(none)
    foot = F.array(place(250, 60, 700, F.concat(F.lit("Page "), F.col("page") + 1, F.lit(" of "), F.col("last") + 1)))
    frame = F.concat(F.when(layout == 1, F.array(*wrapped)).when(layout == 3, F.concat(F.array(*typed), first, ended)).otherwise(F.array(*plain)), foot)
    return rows.select("doc_id", "page", F.inline(F.concat(printed, F.when(F.col("r") % PAGE == 0, frame).otherwise(none))))


def _located(b):
    return tables.located_in(_positioned(b), dealt=True)


def s16_tables(b):
    rows = tables.columns_of(_located(b))
    return rows.select("doc_id", "section", F.col("row_no").cast("int").alias("row_no"), "page", "date", "description", "debit", "credit", "amount", "type")


def s16_evidence(b):
    return _located(b).where("kind != 'ROW'").groupBy("doc_id", "kind", "reason").agg(F.count("*").alias("lines"))


POSITIONED_SQL = f"""{V.BASE}, p AS (SELECT *, account_id * 10000 + year(txn_date) AS doc_id, year(txn_date) % 4 AS layout, row_number() OVER (PARTITION BY account_id, year(txn_date) ORDER BY txn_date, txn_id) - 1 AS r, CAST(amount AS VARCHAR) AS money, CASE WHEN contains(description, ' ') THEN substr(description, strpos(description, ' ') + 1) ELSE '' END AS rest FROM base)"""
S16_TABLES_SQL = f"""WITH {POSITIONED_SQL}
SELECT doc_id, 0 AS section, r AS row_no, r // {PAGE} AS page, CASE layout WHEN 2 THEN strftime(txn_date, '%d-%b-%Y') WHEN 3 THEN strftime(txn_date, '%Y-%m-%d') ELSE strftime(txn_date, '%d/%m/%Y') END AS date,
  CASE WHEN layout = 1 THEN concat_ws(' ', string_split(description, ' ')[1], nullif(rest, ''), txn_id, 'via mobile banking') ELSE description END AS description,
  CASE WHEN layout < 3 AND txn_type = 'EXPENSE' THEN money END AS debit, CASE WHEN layout < 3 AND txn_type = 'INCOME' THEN money END AS credit,
  CASE WHEN layout = 3 THEN money END AS amount, CASE WHEN layout = 3 THEN CASE WHEN txn_type = 'EXPENSE' THEN 'DR' ELSE 'CR' END END AS type FROM p"""
S16_EVIDENCE_SQL = f"""WITH {POSITIONED_SQL}, d AS (SELECT doc_id, layout, count(*) AS n, (max(r) // {PAGE}) + 1 AS pages, count(*) FILTER (rest <> '') AS rests FROM p GROUP BY 1, 2),
e AS (SELECT doc_id, 'EVENT' AS kind, 'REPEATED_HEADER' AS reason, pages - 1 AS lines FROM d UNION ALL SELECT doc_id, 'EVENT', 'FOOTER', pages FROM d
  UNION ALL SELECT doc_id, 'EVENT', 'WRAPPED_HEADER', pages FROM d WHERE layout = 1 UNION ALL SELECT doc_id, 'EVENT', 'CONTINUATION', rests + 2 * n FROM d WHERE layout = 1
  UNION ALL SELECT doc_id, 'EVENT', 'LEADING_LINE', n FROM d WHERE layout = 2
  UNION ALL SELECT doc_id, 'EVENT', 'REPEATED_BANNER', pages - 1 FROM d WHERE layout = 3 UNION ALL SELECT doc_id, 'EVENT', 'TABLE_CLOSED', 1 FROM d WHERE layout = 3
  UNION ALL SELECT doc_id, 'DROPPED', 'BEFORE_HEADER', 1 FROM d WHERE layout = 3 UNION ALL SELECT doc_id, 'TEXT', NULL, 4 FROM d WHERE layout = 3)
SELECT * FROM e WHERE lines > 0"""
S16_ROWS_SQL = """WITH RECURSIVE o AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_discount AS x, l_quantity AS y, l_returnflag AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_quantity, l_discount, l_returnflag) AS r FROM lineitem),
f AS (SELECT doc_id, r, page, y AS anchor, 0 AS row_no FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.r, o.page, CASE WHEN o.page <> f.page OR o.y - anchor > 3 THEN o.y ELSE anchor END, row_no + CASE WHEN o.page <> f.page OR o.y - anchor > 3 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r + 1)
SELECT f.doc_id, f.page, row_no, anchor AS y, string_agg(text, ' ' ORDER BY x, text) AS text FROM f JOIN o ON o.doc_id = f.doc_id AND o.r = f.r GROUP BY 1, 2, 3, 4"""


def _fronts(b):
    """First pages of one account and year as text runs, in five layouts by year: label and value in one run, side by side, in a grid,
    the label behind its value, and in single words."""
    d = b.base.withColumn("doc_id", F.col("account_id") * 10000 + F.year("txn_date")).groupBy("doc_id", "account_id", "user_id").agg(F.min("txn_date").alias("first"), F.max("txn_date").alias("last"), F.sum("amount").alias("total"), F.max("amount").alias("most"))
    layout = (F.col("doc_id") % 5).cast("int")
    name = F.concat(F.lit("A "), F.translate(F.col("user_id").cast("string"), "0123456789", "ghijklmnop"))
    day = F.when(layout == 1, F.date_format("last", "dd MMM yyyy")).otherwise(F.date_format("last", "dd/MM/yyyy"))
    period = F.concat(F.date_format("first", "dd-MM-yyyy"), F.lit(" to "), F.date_format("last", "dd-MM-yyyy"))
    values = [
        ("Account Holder Name", name), ("Account Number", F.concat(F.lit("XXXX"), F.lpad(F.col("account_id").cast("string"), 8, "0"))), ("Branch", F.concat(F.lit("Road "), F.col("user_id"))),
        ("IFSC Code", F.concat(F.lit("ABCD0"), F.lpad(F.col("account_id").cast("string"), 6, "0"))), ("Statement Period", period), ("Credit Limit", F.concat(F.lit("Rs. "), F.col("most"))),
        ("Payment Due Date", day), ("Opening Balance", F.concat(F.col("most"), F.lit(" Dr"))), ("Closing Balance", F.col("total").cast("string")),
    ]
    run = lambda x, y, text: F.struct(F.lit(x).cast("double").alias("x"), (5.0 * F.length(text)).alias("width"), F.lit(y).cast("double").alias("y"), text.alias("text"))
    made = [[], [], [], [], []]
    for k, (label, value) in enumerate(values):
        label, y = F.lit(label), 40 + 15 * k
        made[0].append(run(40, y, F.concat(label, F.lit(" : "), value)))
        made[1] += [run(40, y, label), run(220, y, F.concat(F.lit(": "), value))]
        x, top = 40 + 180 * (k % 3), 40 + 40 * (k // 3)
        made[2] += [run(x, top, label), run(x + 10, top + 14, value)]
        made[3] += [run(40, y, value), run(300, y, label)]
    words = []
    for k, (label, _) in enumerate(values):
        before = 0
        for word in label.split():
            words.append(run(40 + 180 * (k % 3) + 5 * before, 40 + 40 * (k // 3), F.lit(word)))
            before += len(word) + 1
    made[4] = [run(40 + 180 * (k % 3), 54 + 40 * (k // 3), value) for k, (_, value) in enumerate(values)]
    kind = "array<struct<x:double,width:double,y:double,text:string>>"
    runs = F.when(layout == 0, F.array(*made[0]).cast(kind)).when(layout == 1, F.array(*made[1]).cast(kind)).when(layout == 2, F.array(*made[2]).cast(kind)).when(layout == 3, F.array(*made[3]).cast(kind)).otherwise(F.array(*made[4], *words).cast(kind))
    return d.select("doc_id", F.lit(0).alias("page"), F.inline(runs))


def s17_fields(b):
    found = labels.fields(tables.physical_rows(_fronts(b)))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("doc_id", "holder", "last4", "branch", "ifsc", day("period_from"), day("period_to"), F.col("credit_limit").cast("double").alias("credit_limit"), day("due_date"), F.col("opening").cast("double").alias("opening"), F.col("closing").cast("double").alias("closing"))


S17_FIELDS_SQL = f"""WITH {V.BASE}, d AS (SELECT account_id * 10000 + year(txn_date) AS doc_id, account_id, user_id, min(txn_date) AS first, max(txn_date) AS last, sum(amount) AS total, max(amount) AS most FROM base GROUP BY ALL)
SELECT doc_id, 'A ' || translate(CAST(user_id AS VARCHAR), '0123456789', 'ghijklmnop') AS holder, right(lpad(CAST(account_id AS VARCHAR), 8, '0'), 4) AS last4, 'Road ' || user_id AS branch, 'ABCD0' || lpad(CAST(account_id AS VARCHAR), 6, '0') AS ifsc,
  strftime(first, '%Y-%m-%d') AS period_from, strftime(last, '%Y-%m-%d') AS period_to, CAST(most AS DOUBLE) AS credit_limit, strftime(last, '%Y-%m-%d') AS due_date, CAST(-most AS DOUBLE) AS opening, CAST(total AS DOUBLE) AS closing FROM d"""


def s16_cells(b):
    runs = b.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("y"), F.col("l_returnflag").alias("text"))
    anchors = b.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.array(F.lit(5.0), F.lit(20.0), F.lit(40.0))).alias("column", "anchor_x"))
    return statements.bucket_cells(runs, anchors)


def _mails(b):
    """A message for each order: seven merchants by the order's key, whole, or with a stop word, no marker, no total, no date, or other items."""
    key = F.col("o_orderkey")
    money = F.col("o_totalprice").cast("decimal(14,2)")
    part = (money / 4).cast("decimal(14,2)")
    said = F.format_number(money, 2)
    fault = key % 11
    day = F.when(key % 3 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(key % 3 == 1, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    total = F.when(fault == 3, F.lit("soon")).otherwise(said)
    when = F.when(fault == 4, F.lit("today")).otherwise(day)
    shapes = [
        ("amazon.in", "Hello,<b>Order&nbsp;#</b> 171", "", F.concat(F.lit("<p>Order Total: &#8377;"), total, F.lit("</p><i>Order Date: "), when, F.lit("</i>"))),
        ("booking.com", "<h1>Booking  Confirmed</h1>", "<p>Pay at the property</p>", F.concat(F.lit("<td>Amount charged</td><td>INR "), total, F.lit("</td><div>Booked on "), when, F.lit("</div>"))),
        ("olacabs.com", "Ride\nBill", "", F.concat(F.lit("<table><tr><td>Total fare<td>Rs. "), total, F.lit("</table>Ride Date : "), when)),
        ("myntra.com", "Order <b>Confirmed</b>", "Return Initiated", F.concat(F.lit("<!-- Order Total 1.00 -->Order total "), total, F.lit("<br>Order Date "), when)),
        ("food.example", "Thanks for ordering", "It was cancelled", F.concat(F.lit("<table><tr><th>Dish</th><th>Price</th></tr><tr><td>Soup</td><td>₹"), F.format_number(part, 2), F.lit("</td></tr><tr><td>Rice &amp; peas</td><td>₹"), F.format_number(F.when(fault == 5, part).otherwise(money - part), 2), F.lit("</td></tr><tr><td><b>Grand Total</b></td><td>₹ "), total, F.lit("</td></tr></table><table><tr><td>Ordered on</td><td>"), when, F.lit("</td></tr></table>"))),
        ("grocer.example", "TAX INVOICE", "Credit note", F.concat(F.lit("<tr><td>Invoice date<td>"), when, F.lit("<tr><td>1</td><td>Flour</td><td>"), F.format_number(F.when(fault == 5, part).otherwise(money), 2), F.lit("<tr><td></td><td>Amount payable</td><td>"), total, F.lit("</td></tr>"))),
        ("stream.example", "Your receipt", "Free trial", F.concat(F.lit("<style>.a{}</style><div style='display:none'>Total 5.00</div>Billed on "), when, F.lit("<tr><td>Total</td><td>"), total, F.lit("</td></tr>"))),
    ]
    html = lambda shape: F.concat(F.lit("<html><head><title>Order # Booking Confirmed</title></head><body>"), F.when(fault == 1, F.lit("News")).otherwise(F.lit(shape[1])), F.when(fault == 2, F.lit(shape[2])).otherwise(F.lit("")), shape[3], F.lit("</body></html>"))
    at = (key % 8).cast("int")
    return b.table("orders").select(key.alias("message_id"), F.get(F.array(*[F.lit(s[0]) for s in shapes], F.lit("other.example")), at).alias("domain"), F.get(F.array(*[html(s) for s in shapes], F.lit("Order Total: 5.00")), at).alias("html"))


def s18_merchants(b):
    found = receipts.parse(_mails(b), receipts.stored(b.spark), "1998-01-01")
    return found.select("message_id", "domain", "status", "reason", F.col("amount").cast("double").alias("amount"), F.date_format("day", "yyyy-MM-dd").alias("day"), "n_items", F.array_join("violations", ",").alias("violations"))


def s18_try(b):
    """A new template against the messages of the domain without one, and against another's."""
    mails = _mails(b).where("domain in ('other.example', 'olacabs.com')")
    tried = receipts.try_template(mails.drop("domain"), ("other.example", "Total", "(?i)ride", None, None, r"Order Total: ([0-9.]+)", r"(\d{4}-\d{2}-\d{2})", False), "1998-01-01")
    return tried.groupBy("status", "reason").agg(F.count("*").alias("messages"))


S18_MERCHANTS_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS m, o_orderkey % 11 AS f, CAST(o_totalprice AS DECIMAL(14,2)) AS money, CAST(CAST(o_totalprice AS DECIMAL(14,2)) / 4 AS DECIMAL(14,2)) AS part, CAST(o_orderdate AS DATE) AS day FROM orders),
s AS (SELECT *, ['amazon.in', 'booking.com', 'olacabs.com', 'myntra.com', 'food.example', 'grocer.example', 'stream.example', 'other.example'][m + 1] AS domain,
  CASE WHEN m = 7 THEN 'NO_TEMPLATE' WHEN f = 2 AND m IN (1, 3, 4, 5, 6) THEN 'STOP' WHEN f = 1 THEN 'NO_MARKER' WHEN f = 3 AND m < 4 THEN 'AMOUNT_NOT_FOUND' WHEN f = 3 THEN 'AMOUNT_UNREADABLE' WHEN f = 4 AND m IN (4, 5) THEN 'DATE_UNREADABLE' WHEN f = 4 THEN 'DATE_NOT_FOUND' END AS reason FROM o)
SELECT k AS message_id, domain, CASE WHEN reason IN ('NO_TEMPLATE', 'STOP', 'NO_MARKER') THEN 'NOT_A_RECEIPT' WHEN reason IS NOT NULL THEN 'MALFORMED' ELSE 'PARSED' END AS status, reason, CASE WHEN reason IS NULL THEN CAST(money AS DOUBLE) END AS amount, CASE WHEN reason IS NULL THEN strftime(day, '%Y-%m-%d') END AS day,
  CASE WHEN reason IS NULL THEN CASE m WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END END AS n_items,
  CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN day > DATE '1998-01-01' THEN 'DATE_IN_FUTURE' END, CASE WHEN f = 5 AND ((m = 4 AND part + part <> money) OR (m = 5 AND part <> money)) THEN 'ITEMS_DIFFER' END) END AS violations FROM s"""
S18_TRY_SQL = """WITH o AS (SELECT CASE WHEN o_orderkey % 8 = 7 OR o_orderkey % 11 = 1 THEN 1 ELSE 0 END AS other, o_orderkey % 8 = 7 AS own FROM orders WHERE o_orderkey % 8 IN (2, 7))
SELECT CASE WHEN own THEN 'MALFORMED' ELSE 'NOT_A_RECEIPT' END AS status, CASE WHEN own THEN 'DATE_NOT_FOUND' ELSE 'STOP' END AS reason, count(*) AS messages FROM o GROUP BY 1, 2"""


def s20(b):
    after = b.ledger.withColumn("is_recurring", F.col("is_recurring") | (F.col("merchant") == "Brand#1"))
    return sinks.change_set(b.ledger, after, "txn_id", ["is_recurring", "status"]).select("txn_id", "is_recurring", "status")


def s21(b):
    both = [df.groupBy("user_id").agg(F.count("*").alias("rows")).withColumn("entity", F.lit(n)) for n, df in (("transactions", b.base), ("budgets", b.budgets))]
    return both[0].unionByName(both[1])


def s22(b):
    return sinks.content_addresses(b.table("documents"), "text")


ROWS = "r AS (SELECT *, CASE WHEN qty = 49 THEN 'MARKER' WHEN qty = 50 THEN 'UNPARSEABLE' ELSE 'STAGED' END AS outcome FROM base)"
QUERIES = {
    "S1_records": (s1, S1_SQL),
    "S1_S2_S3_headers": (s2, f"WITH {V.BASE} SELECT DISTINCT CAST(account_id AS VARCHAR) AS file, 4 AS header_line, 'txn date|narration|amount|ref no' AS names FROM base"),
    "S4_S5_S6_S11_staged_rows": (s11, f"WITH {V.BASE}, {ROWS} SELECT txn_id AS reference, strftime(txn_date, '%Y-%m-%d') AS txn_date, CAST(amount AS DOUBLE) AS amount, txn_type, description || ', x' AS description FROM r WHERE outcome = 'STAGED'"),
    "S7_date_formats": (s7, f"WITH {V.BASE} SELECT txn_id, f AS form, CASE WHEN f = 1 AND year(txn_date) < 2000 THEN strftime(txn_date + INTERVAL 100 YEAR, '%Y-%m-%d') WHEN f < 6 THEN strftime(txn_date, '%Y-%m-%d') END AS parsed FROM base, (SELECT unnest(range(7)) AS f)"),
    "S8_S9_amounts_and_signs": (s8, f"WITH {V.BASE} SELECT txn_id, f AS form, CAST(CASE f WHEN 0 THEN amount WHEN 1 THEN -amount WHEN 2 THEN amount WHEN 3 THEN -amount WHEN 5 THEN 1234.50 WHEN 6 THEN amount END AS DOUBLE) AS value, CASE f WHEN 1 THEN 'EXPENSE' WHEN 2 THEN 'INCOME' WHEN 6 THEN 'INCOME' END AS sign FROM base, (SELECT unnest(range(7)) AS f)"),
    "S12_S14_rejects": (s14, f"WITH {V.BASE}, {ROWS} SELECT 'NO_AMOUNT' AS reason, 'amount|narration|ref no|txn date' AS columns, count(*) AS rows FROM r WHERE outcome = 'UNPARSEABLE'"),
    "S13_preview_split": (s13, f"WITH {V.BASE}, {ROWS} SELECT CAST(account_id AS VARCHAR) AS file, outcome, count(*) AS rows FROM r GROUP BY 1, 2"),
    "S16_physical_rows": (s16, S16_ROWS_SQL),
    "S16_tables": (s16_tables, S16_TABLES_SQL),
    "S16_evidence": (s16_evidence, S16_EVIDENCE_SQL),
    "S16_column_buckets": (s16_cells, "WITH r AS (SELECT DISTINCT l_orderkey AS doc_id, l_quantity AS x, l_partkey AS y, l_returnflag AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT doc_id, 0 AS page, x, y, text, CASE WHEN abs(x - 5) <= abs(x - 20) THEN 0 WHEN abs(x - 20) <= abs(x - 40) THEN 1 ELSE 2 END AS \"column\" FROM r"),
    "S17_fields": (s17_fields, S17_FIELDS_SQL),
    "S17_metadata": (s17, f"WITH {V.BASE} SELECT DISTINCT CAST(account_id AS VARCHAR) AS file, 'A Holder' AS holder, '1234' AS last4 FROM base"),
    "S18_receipts": (s18, S18_SQL),
    "S18_merchant_receipts": (s18_merchants, S18_MERCHANTS_SQL),
    "S18_template_test": (s18_try, S18_TRY_SQL),
    "J14_staged_duplicates": (j14, f"WITH {V.BASE}, {ROWS}, k AS (SELECT txn_date, amount, description, count(*) AS n FROM base WHERE qty < 25 GROUP BY 1, 2, 3) SELECT txn_id AS reference, coalesce(n, 0) AS matches FROM r LEFT JOIN k USING (txn_date, amount, description) WHERE outcome = 'STAGED'"),
    "S20_change_set": (s20, f"WITH {V.LEDGER} SELECT txn_id, true AS is_recurring, status FROM ledger WHERE merchant = 'Brand#1' AND NOT is_recurring"),
    "S21_export_manifest": (s21, f"WITH {V.BASE}, {V.BUDGETS} SELECT user_id, count(*) AS rows, 'transactions' AS entity FROM base GROUP BY 1 UNION ALL SELECT user_id, count(*), 'budgets' FROM budgets GROUP BY 1"),
    "S22_content_addresses": (s22, "SELECT sha256(text) AS address, count(*) AS files, max(strlen(text)) AS bytes FROM documents GROUP BY 1"),
}
