"""Queries of statement verification, evidence and layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence as EV
from ..operators import layouts as Y
from ..operators import verify as C
from ..sources import views as V

MONEY = "decimal(24,2)"


def statements(b):
    """A statement for each account and month: signed amounts, running balances, some of them wrong or missing."""
    order = Window.partitionBy("statement_id").orderBy("txn_date", "txn_id")
    rows = b.base.withColumn("statement_id", F.concat_ws("/", F.col("account_id").cast("string"), "ym"))
    signed = F.when(F.col("txn_type") == "INCOME", F.col("amount")).otherwise(-F.col("amount")).cast(MONEY)
    rows = rows.withColumn("signed", signed).withColumn("row_no", F.row_number().over(order)).withColumn("running", (F.lit(1000).cast(MONEY) + F.sum("signed").over(order)).cast(MONEY))
    wrong = F.when(F.col("qty") == 50, 1).when(F.col("qty") == 49, 2).otherwise(0).cast(MONEY)
    balance = F.when(F.col("qty") % 7 != 0, F.col("running") + wrong)
    return rows.select("statement_id", "row_no", "txn_id", "txn_date", F.when((F.col("tax") != 0) | (F.col("qty") != 7), F.col("signed")).cast(MONEY).alias("amount"), balance.cast(MONEY).alias("balance"), "tax", "qty")


def openings(b):
    return statements(b).select("statement_id").distinct().withColumn("opening", F.when(F.crc32("statement_id") % 5 != 0, F.lit(1000)).cast(MONEY))


ST = f"""{V.BASE}, s0 AS (SELECT *, account_id || '/' || ym AS statement_id, CASE WHEN txn_type = 'INCOME' THEN amount ELSE -amount END AS signed FROM base),
s1 AS (SELECT *, row_number() OVER w AS row_no, 1000 + sum(signed) OVER w AS running FROM s0 WINDOW w AS (PARTITION BY statement_id ORDER BY txn_date, txn_id)),
st AS (SELECT statement_id, row_no, txn_id, txn_date, CASE WHEN tax <> 0 OR qty <> 7 THEN signed END AS amount, CASE WHEN qty % 7 <> 0 THEN running + CASE qty WHEN 50 THEN 1 WHEN 49 THEN 2 ELSE 0 END END AS balance, tax, qty FROM s1)"""


def v1(b):
    known = statements(b).select("statement_id").distinct().withColumn("opening", F.lit(1000).cast(MONEY))
    return C.balance_chain(statements(b), known)


V1_SQL = f"""WITH RECURSIVE {ST}, w AS (SELECT statement_id, row_no, amount, balance,
    CAST(CASE WHEN amount IS NOT NULL THEN 1000 + amount END AS DECIMAL(24,2)) AS expected, CAST(CASE WHEN amount IS NULL THEN balance WHEN balance IS NOT NULL THEN balance ELSE 1000 + amount END AS DECIMAL(24,2)) AS running FROM st WHERE row_no = 1
  UNION ALL SELECT s.statement_id, s.row_no, s.amount, s.balance, CAST(w.running + s.amount AS DECIMAL(24,2)), CAST(CASE WHEN s.amount IS NULL THEN s.balance WHEN s.balance IS NOT NULL THEN s.balance ELSE w.running + s.amount END AS DECIMAL(24,2)) FROM w JOIN st s ON s.statement_id = w.statement_id AND s.row_no = w.row_no + 1),
c AS (SELECT statement_id, count(*) FILTER (balance IS NOT NULL AND expected IS NOT NULL) AS pairs, count(*) FILTER (balance <> expected) AS off FROM w GROUP BY 1)
SELECT *, CASE WHEN pairs < 2 THEN 'NOT_APPLICABLE' WHEN off = 0 THEN 'VERIFIED' WHEN off >= 2 AND off * 2 >= pairs THEN 'FAILED' ELSE 'WARNING' END AS verdict FROM c"""


def v2(b):
    return C.day_orders(statements(b).where("amount is not null and balance is not null")).withColumn("txn_date", F.date_format("txn_date", "yyyy-MM-dd")).withColumn("closing", F.col("closing").cast("double"))


V2_SQL = f"""WITH {ST}, e AS (SELECT statement_id, txn_date, balance AS b, 1 AS step FROM st WHERE amount IS NOT NULL AND balance IS NOT NULL UNION ALL SELECT statement_id, txn_date, balance - amount, -1 FROM st WHERE amount IS NOT NULL AND balance IS NOT NULL),
n AS (SELECT statement_id, txn_date, b, sum(step) AS net FROM e GROUP BY 1, 2, 3), g AS (SELECT statement_id, txn_date, count(*) FILTER (net > 0) AS closes, max(CASE WHEN net = 1 THEN b END) AS closing, max(abs(net)) AS most FROM n GROUP BY 1, 2)
SELECT statement_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, CASE WHEN closes = 1 AND most = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS "order", CAST(CASE WHEN closes = 1 AND most = 1 THEN closing END AS DOUBLE) AS closing FROM g"""


def v3(b):
    known = statements(b).select("statement_id").distinct().withColumn("opening", F.when(~F.col("statement_id").endswith("5"), F.lit(1000)).cast(MONEY))
    t = C.statement_totals(statements(b), known)
    return t.withColumn("moved", F.col("moved").cast("double")).withColumn("closing", F.col("closing").cast("double"))


V3_SQL = f"""WITH {ST}, g AS (SELECT statement_id, CASE WHEN statement_id NOT LIKE '%5' THEN 1000 END AS opening, sum(amount) AS moved, arg_max(balance, row_no) FILTER (balance IS NOT NULL) AS closing, count(*) FILTER (amount IS NULL) AS skipped FROM st GROUP BY 1)
SELECT statement_id, CAST(moved AS DOUBLE) AS moved, CAST(closing AS DOUBLE) AS closing, CASE WHEN closing IS NULL OR opening IS NULL THEN 'NOT_APPLICABLE' WHEN opening + moved - closing = 0 THEN 'VERIFIED' ELSE 'FAILED' END AS verdict,
  CASE WHEN closing IS NOT NULL AND opening IS NOT NULL THEN CASE WHEN opening + moved - closing = 0 THEN 'NONE' WHEN skipped > 0 THEN 'SKIPPED_ROWS' WHEN abs(opening + moved - closing) % 2 = 0 THEN 'DIRECTION' ELSE 'AMOUNTS' END END AS cause FROM g"""


def _is_printed():
    return F.expr("qty < 48 or tax > 4")


def _printed(b):
    return statements(b).where(_is_printed()).groupBy("statement_id").agg(*C.flows("printed_"))


def v4(b):
    return C.summary_totals(statements(b), _printed(b))


V4_SQL = f"""WITH {ST}, r AS (SELECT statement_id, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS c, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS d, count(*) FILTER (amount > 0) AS nc, count(*) FILTER (amount < 0) AS nd FROM st GROUP BY 1),
p AS (SELECT statement_id, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS pc, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS pd, count(*) FILTER (amount > 0) AS pnc, count(*) FILTER (amount < 0) AS pnd FROM st WHERE qty < 48 OR tax > 4 GROUP BY 1)
SELECT statement_id, CASE WHEN pnc = nc AND pnd = nd AND pc = c AND pd = d THEN 'NONE' WHEN (pnc <> nc OR pnd <> nd) AND pnc + pnd = nc + nd THEN 'DIRECTION' WHEN (pnc <> nc OR pnd <> nd) AND pc = c AND pd = d THEN 'ROW_GROUPING' WHEN pnc <> nc OR pnd <> nd THEN 'MISSING_OR_EXTRA_ROWS' ELSE 'AMOUNTS' END AS cause,
  CASE WHEN pnc <> nc OR pnd <> nd OR pc <> c OR pd <> d THEN 'WARNING' ELSE 'VERIFIED' END AS verdict FROM p JOIN r USING (statement_id)"""


def v5(b):
    cell = lambda c: F.concat(c.cast("string"), F.lit(".00"))
    rows = b.base.select(F.col("account_id").alias("statement_id"), F.when(F.col("qty") > 47, F.concat_ws(" ", cell(F.col("qty")), cell(F.col("tax")))).when(F.col("txn_type") == "EXPENSE", cell(F.col("qty"))).otherwise(F.lit("")).alias("debit"), F.when((F.col("txn_type") == "INCOME") | (F.col("tax") == 8), cell(F.col("qty"))).otherwise(F.lit("")).alias("credit"))
    return C.column_ambiguity(rows)


def v6(b):
    outcome = F.when(F.col("qty") == 50, "UNPARSEABLE").when(F.col("qty") == 1, "MARKER").otherwise("STAGED")
    return C.row_accounting(b.base.select((F.col("account_id")).alias("statement_id"), outcome.alias("outcome")))


def _cards(b):
    t = b.table("orders")
    m = lambda c: c.cast(MONEY)
    key = F.col("o_orderkey")
    return t.select(key.alias("statement_id"), m(key % 500).alias("previous"), m(key % 300).alias("purchases"), m(key % 7).alias("cash"), m(key % 3).alias("fees"), m(key % 200).alias("payments"), m(key % 500 + key % 300 + key % 7 + key % 3 - key % 200 + F.when(key % 11 == 0, 1).otherwise(0)).alias("due"))


def v7(b):
    return C.card_totals(_cards(b)).withColumn("expected", F.col("expected").cast("double"))


def v8(b):
    key = F.col("l_orderkey")
    rows = b.table("lineitem").groupBy(key.alias("statement_id")).agg(F.count("*").alias("n")).select("statement_id", F.explode(F.array((-(F.col("statement_id") % 300)).cast(MONEY), (F.col("statement_id") % 200 + F.when(F.col("n") > 6, 1).otherwise(0)).cast(MONEY))).alias("amount"))
    return C.card_flow(rows, _cards(b))


def v9(b):
    opening = lambda given: F.when(given, F.lit(1000)).cast(MONEY)
    rows = statements(b).withColumn("opening", opening(F.lit(True))).withColumn("total_opening", opening(~F.col("statement_id").endswith("5"))).withColumn("printed", _is_printed())
    return C.reliability(C.findings(rows))


V9_SQL = f"""WITH f AS (SELECT statement_id, verdict FROM ({V1_SQL}) UNION ALL SELECT statement_id, verdict FROM ({V3_SQL}) UNION ALL SELECT statement_id, verdict FROM ({V4_SQL}))
SELECT statement_id, count(*) AS findings, CASE WHEN bool_or(verdict = 'FAILED') THEN 'NEEDS_ATTENTION' WHEN bool_or(verdict = 'WARNING') THEN 'REVIEW_RECOMMENDED' ELSE 'CLEAN' END AS status FROM f GROUP BY 1"""


def v10(b):
    rows = statements(b).groupBy("statement_id").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(F.lit(0).cast(MONEY))).alias("credits"), F.sum(F.when(F.col("amount") < 0, -F.col("amount")).otherwise(F.lit(0).cast(MONEY))).alias("debits"), F.count(F.when(F.col("amount").isNull(), 1)).alias("skipped"), F.max_by("balance", "row_no").alias("closing"))
    return C.closing_guard(rows.withColumn("opening", F.when(F.col("rows") > 1, F.lit(1000)).cast(MONEY)).withColumn("liability", F.col("statement_id").startswith("9")))


V10_SQL = f"""WITH {ST}, g AS (SELECT statement_id, count(*) AS rows, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS c, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS d, count(*) FILTER (amount IS NULL) AS skipped, max(CASE WHEN row_no = n THEN balance END) AS closing FROM (SELECT *, count(*) OVER (PARTITION BY statement_id) AS n FROM st) GROUP BY 1)
SELECT statement_id, CASE WHEN closing IS NULL THEN 'NOT_APPLICABLE' WHEN skipped > 0 OR rows < 2 THEN 'UNCORROBORATED' WHEN closing = 1000 + CASE WHEN statement_id LIKE '9%' THEN d - c ELSE c - d END THEN 'CORROBORATED' ELSE 'UNCORROBORATED' END AS guard FROM g"""


def e1(b):
    return C.evidence_status(b.events.select((F.col("event_id") % 3000).alias("claim_id"), F.col("action").alias("source"), F.when(F.col("k") > 20, F.col("k") % 2).alias("value")))


def e2(b):
    x, y = F.when(F.col("k") % 3 > 0, F.col("k") % 4), F.when(F.col("k") % 5 > 0, F.col("k") % 2)
    return b.events.groupBy(C.comparison(x, y).alias("result")).agg(F.count("*").alias("n"))


def e3(b):
    return C.dimensions(b.events.select((F.col("event_id") % 4000).alias("claim_id"), F.col("action").alias("dimension"), (F.col("k") > 50).alias("holds")))


E3_FIELDS = ["TRANSACTION_AMOUNT", "OPENING_BALANCE", "CLOSING_BALANCE", "TRANSACTION_DATE", "TRANSACTION_DIRECTION"]


def e3_assessed(b):
    """Claims with two or three facts each: words of lines of pages are the provenance, checks rest on pages or on nothing known."""
    claim = F.floor(F.col("event_id") / 3)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    e = b.events.select(claim.alias("claim_id"), "event_id", "k", "action")
    field = pick(E3_FIELDS, F.col("claim_id") % 5)
    value = F.when(F.col("k") % 13 != 0, F.concat(F.lit("v"), F.col("claim_id") % 7 + (F.col("k") % 8 == 0).cast("int")))
    node = F.when(F.col("k") % 17 != 0, F.concat(F.lit("w"), F.col("k")))
    facts = e.select("claim_id", field.alias("field"), pick(["SECTION_TEXT", "ROW_DATA", "DOCUMENT_TEXT", "COLUMN_HEADERS"], F.col("k") % 4).alias("source"), value.alias("value"), node.alias("node"))
    k = b.events.select("k").distinct()
    nodes = k.select(F.concat(F.lit("w"), "k").alias("node"), F.concat(F.lit("l"), F.col("k") % 20).alias("parent")).union(k.select(F.concat(F.lit("l"), F.col("k") % 20), F.concat(F.lit("p"), F.col("k") % 20 % 5))).union(k.select(F.concat(F.lit("p"), F.col("k") % 20 % 5), F.lit(None)))
    finance = e.where("event_id % 3 = 1").select("claim_id", F.when(F.col("k") % 5 < 3, "HOLDS").when(F.col("k") % 5 == 3, "BROKEN").alias("chain"), F.when(F.col("k") % 3 == 0, "VERIFIED").when(F.col("k") % 3 == 1, "FAILED").alias("totals"), F.when(F.col("k") % 2 == 0, "OPENING_BALANCE").alias("cause"), F.when(F.col("k") % 6 > 0, F.concat(F.lit("p"), F.col("k") % 5)).alias("node"))
    return EV.assess(facts, nodes, finance)


E3_SQL = f"""WITH RECURSIVE {V.EVENTS}, e AS (SELECT event_id // 3 AS claim_id, event_id, k FROM ev),
n AS (SELECT DISTINCT 'w' || k AS node, 'l' || (k % 20) AS parent FROM ev UNION SELECT DISTINCT 'l' || (k % 20), 'p' || (k % 20 % 5) FROM ev UNION SELECT DISTINCT 'p' || (k % 20 % 5), NULL FROM ev),
up AS (SELECT node, node AS up FROM n UNION SELECT up.node, n.parent FROM up JOIN n ON n.node = up.up WHERE n.parent IS NOT NULL),
f AS (SELECT claim_id, event_id, ['TRANSACTION_AMOUNT', 'OPENING_BALANCE', 'CLOSING_BALANCE', 'TRANSACTION_DATE', 'TRANSACTION_DIRECTION'][claim_id % 5 + 1] AS field, [2, 3, 1, 4][k % 4 + 1] AS rank, 'v' || (claim_id % 7 + CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) AS value, CASE WHEN k % 17 <> 0 THEN 'w' || k END AS node FROM e WHERE k % 13 <> 0),
fl AS (SELECT f.*, coalesce(list_sort(list(DISTINCT up.up) FILTER (up.up IS NOT NULL)), []) AS lines FROM f LEFT JOIN up ON up.node = f.node GROUP BY f.claim_id, f.event_id, f.field, f.rank, f.value, f.node),
c AS (SELECT claim_id, min(field) AS field, count(*) AS facts, count(DISTINCT value) AS vals, max(rank) AS rank, list_distinct(flatten(list(lines))) AS all_lines FROM fl GROUP BY 1),
s AS (SELECT claim_id, lines AS strongest FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank DESC, lines DESC) AS r FROM fl) WHERE r = 1),
i AS (SELECT DISTINCT x.claim_id FROM fl x JOIN fl y ON x.claim_id = y.claim_id AND x.event_id < y.event_id AND x.value = y.value AND NOT list_has_any(x.lines, y.lines)),
k AS (SELECT e.claim_id, CASE WHEN k % 5 < 3 THEN 'HOLDS' WHEN k % 5 = 3 THEN 'BROKEN' END AS chain, CASE WHEN k % 3 = 0 THEN 'VERIFIED' WHEN k % 3 = 1 THEN 'FAILED' END AS totals, k % 2 = 0 AS opening, CASE WHEN k % 6 > 0 THEN ['p' || (k % 5)] ELSE [] END AS check_lines FROM e WHERE event_id % 3 = 1),
d AS (SELECT c.claim_id, CASE WHEN rank > 2 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS structural, CASE WHEN facts < 2 THEN 'INSUFFICIENT' WHEN vals > 1 THEN 'CONFLICTING' WHEN i.claim_id IS NOT NULL THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS corroboration,
  CASE WHEN field IN ('TRANSACTION_AMOUNT', 'TRANSACTION_DIRECTION') THEN CASE chain WHEN 'HOLDS' THEN 'SUPPORTED' WHEN 'BROKEN' THEN 'CONFLICTING' ELSE 'INSUFFICIENT' END
    WHEN field IN ('OPENING_BALANCE', 'CLOSING_BALANCE') AND totals = 'VERIFIED' THEN 'SUPPORTED' WHEN field = 'OPENING_BALANCE' AND totals = 'FAILED' AND opening THEN 'CONFLICTING' ELSE 'INSUFFICIENT' END AS financial, strongest, all_lines, coalesce(check_lines, []) AS check_lines
  FROM c JOIN s ON s.claim_id = c.claim_id LEFT JOIN i ON i.claim_id = c.claim_id LEFT JOIN k ON k.claim_id = c.claim_id)
SELECT claim_id, structural, corroboration, financial, CASE WHEN 'CONFLICTING' IN (structural, corroboration, financial) THEN 'CONFLICTING'
  WHEN (structural = 'SUPPORTED' AND corroboration = 'SUPPORTED' AND NOT list_has_any(strongest, all_lines)) OR (structural = 'SUPPORTED' AND financial = 'SUPPORTED' AND NOT list_has_any(strongest, check_lines)) OR (corroboration = 'SUPPORTED' AND financial = 'SUPPORTED' AND NOT list_has_any(all_lines, check_lines)) THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM d"""


def _facts(b, shift):
    # the second reading sees every day one later and some amounts otherwise; forty facts a document
    seen = F.floor("value") + (F.col("user_id") % 3 == shift).cast("int") * shift
    return b.events.select(F.floor(F.col("event_id") / 40).alias("doc_id"), (F.col("k") % 3).alias("page"), F.col("event_id").alias("n"), F.date_add(F.to_date("ts"), F.lit(shift)).alias("d"), seen.cast("double").alias("amount"), (F.col("action") == "click").alias("inflow"), F.array("action").alias("words"), (F.col("k") * 10.0).alias("top"), (F.col("k") * 10.0 + 8 + shift).alias("bottom"))


def e5(b):
    return C.fact_scores(_facts(b, 0), _facts(b, 1)).where("score >= 8")


E5_SQL = f"""WITH {V.EVENTS}, f AS (SELECT event_id // 40 AS doc_id, k % 3 AS page, event_id AS n, CAST(ts AS DATE) AS d, floor(value) AS amount, floor(value) + CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END AS other, action = 'click' AS inflow, action AS w, k * 10.0 AS top FROM ev),
p AS (SELECT x.doc_id, x.page, x.n AS n_x, y.n AS n_y, abs(date_diff('day', x.d, y.d + 1)) AS days, abs(x.amount - y.other) AS off, abs(x.amount - y.other) <= abs(x.amount) * 0.001 AS near, x.inflow = y.inflow AS dir, x.w = y.w AS same,
  greatest(0.0, least(x.top + 8, y.top + 9) - greatest(x.top, y.top)) / greatest(1e-9, greatest(x.top + 8, y.top + 9) - least(x.top, y.top)) AS lap FROM f x JOIN f y USING (doc_id, page)),
s AS (SELECT *, CASE days WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN off = 0 THEN 3 WHEN near THEN 1 ELSE 0 END + CASE WHEN dir THEN 2 ELSE 0 END + CASE WHEN same THEN 2 ELSE 0 END + CASE WHEN lap > 0.3 THEN 2 ELSE 0 END + CASE WHEN n_x = n_y THEN 1 ELSE 0 END AS score FROM p)
SELECT doc_id, page, n_x, n_y, score, CASE WHEN (days > 1 AND NOT near AND lap = 0) OR (lap = 0 AND n_x <> n_y) THEN 'DIFFERENT' WHEN score >= 10 AND (lap > 0.3 OR n_x = n_y) THEN 'SAME' ELSE 'UNCERTAIN' END AS verdict FROM s WHERE score >= 8"""


def e4(b):
    facts = b.events.select((F.col("event_id") % 300).alias("doc_id"), (F.col("k") % 3).alias("page"), F.col("event_id").alias("n"), (F.col("k") * 1.5).alias("top"), (F.col("action") == "click").alias("anchor"))
    return C.same_fact_groups(facts)


def s_layout(b):
    headers = F.split(F.substring_index("text", "\n", 1), " ")
    return b.table("documents").select("doc_id", Y.fingerprint(F.col("lang"), headers).alias("fingerprint"))


LAYOUT_SQL = "WITH d AS (SELECT doc_id, lang, string_split(string_split(text, chr(10))[1], ' ') AS h FROM documents) SELECT doc_id, 'FP-1-' || upper(substr(sha256(lang || '|' || len(h) || '|' || array_to_string(list_sort(list_distinct(list_transform(h, lambda x: lower(trim(x))))), ',')), 1, 8)) AS fingerprint FROM d"


def a34(b):
    return Y.summary(b.imports)


def _registry(b):
    return b.table("nation").select(F.concat(F.lit("src"), F.col("n_nationkey"), F.lit("en")).alias("fingerprint"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 3).alias("registered_first"), F.lit(500).alias("registered_last"))


def j6(b):
    return Y.with_registry(Y.summary(b.imports), _registry(b))


def _caps(b):
    one = F.element_at(F.array(*map(F.lit, ["dates", "amounts", "balances", "refs", "notes"])), F.col("bit") + 1)
    return b.imports.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("import_id % (bit + 2) != 1").withColumn("capability", one)


CAPS = f"{V.IMPORTS}, caps AS (SELECT i.*, ['dates', 'amounts', 'balances', 'refs', 'notes'][bit + 1] AS capability FROM imports i, (SELECT unnest(range(5)) AS bit) WHERE import_id % (bit + 2) <> 1)"


def a34_caps(b):
    return Y.capabilities(_caps(b))


def a33(b):
    known = b.spark.createDataFrame([(x,) for x in ("dates", "amounts", "balances", "refs", "notes", "never")], "capability string")
    return Y.coverage(_caps(b), known)


def a35(b):
    rows = b.table("documents").select(F.col("doc_id").alias("import_id"), F.concat("source", "lang").alias("fingerprint"), (F.col("doc_id") % 400).alias("day"), F.explode(F.array_distinct(F.split(F.lower(F.substring_index("text", "\n", 1)), " "))).alias("header"))
    return Y.unknown_headers(rows.where("header != ''"))


def a36(b):
    return Y.encounters(b.imports)


def a37(b):
    return Y.failures(b.imports.withColumn("code", F.concat(F.lit("E"), F.col("import_id") % 6)))


def a38(b):
    return Y.recent_summary(b.imports, 200)


def a38_analyses(b):
    """The events as analyses: outcome, layout, rows and reasons (some blank, some no JSON, some with other values) by their value."""
    k = F.col("k")
    reasons = F.when(k % 9 == 0, F.lit("{bad")).when(k % 11 == 0, F.lit(" ")).when(k % 14 == 0, F.lit('{"NO_DATE":"many"}')).when(k % 5 == 0, F.lit(None)).otherwise(F.format_string('{"NO_DATE":%d,"SHAPE:%d":%d}', k % 4, k % 3, k % 7))
    sessions = b.events.select(F.col("event_id").alias("session_id"), F.col("ts").alias("at"), F.when(F.col("action") == "error", "FAILED").when(F.col("action") == "view", "PARSED").otherwise("OPEN").alias("outcome"), F.when(k % 6 > 0, k % 31).alias("layout"), F.when(k % 8 > 0, k).alias("rows"), reasons.alias("reasons"))
    return Y.analysis_summary(sessions, 500)


A38_SQL = f"""WITH {V.EVENTS}, s AS (SELECT event_id, ts, action, k, CASE WHEN k % 6 > 0 THEN k % 31 END AS layout, CASE WHEN k % 8 > 0 THEN k END AS rows,
  CASE WHEN k % 9 = 0 THEN 'BAD' WHEN k % 11 = 0 THEN 'BLANK' WHEN k % 14 = 0 THEN 'BAD' WHEN k % 5 = 0 THEN 'BLANK' ELSE 'GOOD' END AS json FROM ev),
r AS (SELECT * FROM s ORDER BY ts DESC, event_id DESC LIMIT 500), h AS (SELECT 'NO_DATE' AS key, k % 4 AS n FROM r WHERE json = 'GOOD' UNION ALL SELECT 'SHAPE:' || (k % 3), k % 7 FROM r WHERE json = 'GOOD')
SELECT 'ALL' AS part, 'sessions' AS key, count(*) AS n FROM s UNION ALL SELECT 'ALL', 'PARSED', count(*) FILTER (action = 'view') FROM s UNION ALL SELECT 'ALL', 'FAILED', count(*) FILTER (action = 'error') FROM s UNION ALL SELECT 'ALL', 'layouts', count(DISTINCT layout) FROM s
UNION ALL SELECT 'RECENT', 'sessions', count(*) FROM r UNION ALL SELECT 'RECENT', 'rows', CAST(coalesce(sum(rows), 0) AS BIGINT) FROM r UNION ALL SELECT 'RECENT', 'unanchored', CAST(coalesce(sum(n), 0) AS BIGINT) FROM h UNION ALL SELECT 'RECENT', 'unreadable', count(*) FILTER (json = 'BAD') FROM r
UNION ALL SELECT 'REASON', key, CAST(sum(n) AS BIGINT) FROM h GROUP BY key"""


def w7_layout(b):
    return Y.changed_headers(b.imports)


def s25(b):
    return Y.merge_registry(_registry(b).select("fingerprint", "name", F.col("registered_first").alias("first_day"), F.col("registered_last").alias("last_day"), F.lit(1).cast("long").alias("uses")), Y.summary(b.imports))


def s24(b):
    old = b.events.where("k < 50").select("user_id", "action", F.lit("old").alias("v")).distinct()
    return Y.latest_wins(old, b.events.where("k >= 80 and user_id < 60").select("user_id", "action", F.lit("new").alias("v")).distinct(), ["user_id", "action"])


def s23(b):
    old = b.events.where("action = 'click' and k < 5").select("user_id").distinct().withColumn("v", F.lit("old"))
    return Y.insert_absent(old, b.events.where("action = 'view'").select("user_id").distinct().withColumn("v", F.lit("new")), ["user_id"])


FIND = "count(*) FILTER"
QUERIES = {
    "V1_W5_balance_chain": (v1, V1_SQL),
    "V2_day_order": (v2, V2_SQL),
    "V3_statement_totals": (v3, V3_SQL),
    "V4_summary_totals": (v4, V4_SQL),
    "V5_column_ambiguity": (v5, f"WITH {V.BASE}, c AS (SELECT account_id AS statement_id, CASE WHEN qty > 47 THEN qty || '.00 ' || tax || '.00' WHEN txn_type = 'EXPENSE' THEN qty || '.00' ELSE '' END AS debit, CASE WHEN txn_type = 'INCOME' OR tax = 8 THEN qty || '.00' ELSE '' END AS credit FROM base) SELECT statement_id, count(*) AS rows, {FIND} (len(regexp_extract_all(debit, '[0-9][0-9,]*\\.[0-9]{{2}}')) > 1 OR len(regexp_extract_all(credit, '[0-9][0-9,]*\\.[0-9]{{2}}')) > 1) AS two_amounts, {FIND} (regexp_matches(debit, '[1-9]') AND regexp_matches(credit, '[1-9]')) AS both_sides FROM c GROUP BY 1"),
    "V6_row_accounting": (v6, f"WITH {V.BASE}, g AS (SELECT account_id AS statement_id, count(*) AS rows, {FIND} (qty BETWEEN 2 AND 49) AS staged, {FIND} (qty = 1) AS marker, {FIND} (qty = 50) AS unparseable FROM base GROUP BY 1) SELECT *, CASE WHEN unparseable = 0 THEN 'VERIFIED' WHEN unparseable * 2 >= rows THEN 'FAILED' ELSE 'WARNING' END AS verdict FROM g"),
    "V7_card_totals": (v7, "SELECT o_orderkey AS statement_id, CAST(o_orderkey % 500 + o_orderkey % 300 + o_orderkey % 7 + o_orderkey % 3 - o_orderkey % 200 AS DOUBLE) AS expected, CASE WHEN o_orderkey % 11 <> 0 THEN 'VERIFIED' ELSE 'WARNING' END AS verdict FROM orders"),
    "V8_card_flow": (v8, "WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS statement_id, CASE WHEN n IS NOT NULL AND (n <= 6) THEN 'VERIFIED' ELSE 'WARNING' END AS verdict FROM orders LEFT JOIN n ON k = o_orderkey"),
    "V9_reliability": (v9, V9_SQL),
    "V10_closing_guard": (v10, V10_SQL),
    "E1_evidence_status": (e1, f"WITH {V.EVENTS}, f AS (SELECT event_id % 3000 AS claim_id, action, CASE WHEN k > 20 THEN k % 2 END AS v FROM ev) SELECT claim_id, CASE WHEN count(v) < 2 THEN 'INSUFFICIENT' WHEN count(DISTINCT v) > 1 THEN 'CONFLICTING' WHEN count(DISTINCT CASE WHEN v IS NOT NULL THEN action END) >= 2 THEN 'SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM f GROUP BY 1"),
    "E2_comparison": (e2, f"WITH {V.EVENTS}, f AS (SELECT CASE WHEN k % 3 > 0 THEN k % 4 END AS a, CASE WHEN k % 5 > 0 THEN k % 2 END AS b FROM ev) SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'ABSENT' WHEN a IS NULL OR b IS NULL THEN 'UNCONTESTED' WHEN a = b THEN 'AGREE' ELSE 'DISAGREE' END AS result, count(*) AS n FROM f GROUP BY 1"),
    "E3_dimensions": (e3, f"WITH {V.EVENTS} SELECT event_id % 4000 AS claim_id, count(DISTINCT CASE WHEN k > 50 THEN action END) AS held, count(DISTINCT CASE WHEN k > 50 THEN action END) >= 2 AS assured FROM ev GROUP BY 1"),
    "E4_same_fact_groups": (e4, f"WITH {V.EVENTS}, f AS (SELECT event_id % 300 AS doc_id, k % 3 AS page, event_id AS n, k * 1.5 AS top, action = 'click' AS anchor FROM ev) SELECT x.doc_id, x.page, x.n, arg_min(a.n, (abs(x.top - a.top), a.n)) AS \"group\" FROM f x JOIN f a ON a.anchor AND a.doc_id = x.doc_id AND a.page = x.page AND abs(x.top - a.top) <= 3 GROUP BY 1, 2, 3"),
    "E5_fact_scores": (e5, E5_SQL),
    "S_layout_fingerprint": (s_layout, LAYOUT_SQL),
    "A33_U3_capability_coverage": (a33, f"WITH {CAPS} SELECT c AS capability, count(DISTINCT import_id) AS activations, round(count(DISTINCT import_id) / (SELECT count(DISTINCT import_id) FROM caps), 6) AS ratio FROM (SELECT unnest(['dates', 'amounts', 'balances', 'refs', 'notes', 'never']) AS c) LEFT JOIN caps ON capability = c GROUP BY 1"),
    "A34_layout_summary": (a34, f"WITH {V.IMPORTS} SELECT fingerprint, count(*) AS uses, min(day) AS first_day, max(day) AS last_day, CAST(sum(rows) AS BIGINT) AS rows, list_sort(list(duration))[count(*) // 2 + 1] AS median FROM imports GROUP BY 1"),
    "A34_stable_capabilities": (a34_caps, f"WITH {CAPS}, n AS (SELECT fingerprint, count(DISTINCT import_id) AS n FROM caps GROUP BY 1) SELECT fingerprint, capability, count(DISTINCT import_id) AS \"with\", count(DISTINCT import_id) = any_value(n) AS stable FROM caps JOIN n USING (fingerprint) GROUP BY 1, 2"),
    "A35_unknown_headers": (a35, "WITH h AS (SELECT doc_id, source || lang AS fp, doc_id % 400 AS day, unnest(list_distinct(string_split(lower(string_split(text, chr(10))[1]), ' '))) AS header FROM documents) SELECT header, count(DISTINCT doc_id) AS imports, count(DISTINCT fp) AS layouts, min(day) AS first_day, max(day) AS last_day FROM h WHERE header <> '' GROUP BY 1"),
    "A36_W9_encounters": (a36, f"WITH {V.IMPORTS}, m AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY day, import_id) = 1 AS first_time FROM imports) SELECT first_time, count(*) AS imports, round(avg(rows), 4) AS mean_rows, list_sort(list(duration))[count(*) // 2 + 1] AS median FROM m GROUP BY 1"),
    "A37_failures": (a37, f"WITH {V.IMPORTS}, p AS (SELECT 'E' || import_id % 6 AS code, fingerprint, count(*) AS n FROM imports GROUP BY 1, 2) SELECT code, CAST(sum(n) AS BIGINT) AS failures, arg_min(fingerprint, (-n, fingerprint)) AS dominant FROM p GROUP BY 1"),
    "A38_analysis_summary": (a38_analyses, A38_SQL),
    "E3_assessment": (e3_assessed, E3_SQL),
    "A38_recent_summary": (a38, f"WITH {V.IMPORTS}, r AS (SELECT * FROM imports ORDER BY import_id DESC LIMIT 200) SELECT bank, count(*) AS imports, CAST(sum(rows) AS BIGINT) AS rows FROM r GROUP BY 1"),
    "A46_J6_layouts_with_registry": (j6, f"WITH {V.IMPORTS}, s AS (SELECT fingerprint, count(*) AS uses, min(day) AS f, max(day) AS l, CAST(sum(rows) AS BIGINT) AS rows FROM imports GROUP BY 1), g AS (SELECT 'src' || n_nationkey || 'en' AS fingerprint, n_name AS name, n_nationkey % 3 AS rf, 500 AS rl FROM nation) SELECT coalesce(s.fingerprint, g.fingerprint) AS fingerprint, coalesce(name, 'unnamed') AS name, coalesce(uses, 0) AS uses, coalesce(rows, 0) AS rows, coalesce(rf, f) AS first_day, coalesce(rl, l) AS last_day FROM s FULL OUTER JOIN g ON s.fingerprint = g.fingerprint"),
    "W7_layout_changes": (w7_layout, f"WITH {V.IMPORTS} SELECT import_id, coalesce(fingerprint <> lag(fingerprint) OVER (PARTITION BY bank ORDER BY day, import_id), false) AS changed FROM imports"),
    "S25_registry_merge": (s25, f"WITH {V.IMPORTS}, b AS (SELECT 'src' || n_nationkey || 'en' AS fingerprint, n_name AS name, n_nationkey % 3 AS f, 500 AS l, 1 AS u FROM nation UNION ALL SELECT fingerprint, NULL, min(day), max(day), count(*) FROM imports GROUP BY 1) SELECT fingerprint, max(name) AS name, min(f) AS first_day, max(l) AS last_day, CAST(sum(u) AS BIGINT) AS uses FROM b GROUP BY 1"),
    "S24_latest_wins": (s24, f"WITH {V.EVENTS}, n AS (SELECT DISTINCT user_id, action FROM ev WHERE k >= 80 AND user_id < 60), o AS (SELECT DISTINCT user_id, action FROM ev WHERE k < 50) SELECT user_id, action, 'new' AS v FROM n UNION ALL SELECT user_id, action, 'old' FROM o ANTI JOIN n USING (user_id, action)"),
    "S23_insert_absent": (s23, f"WITH {V.EVENTS}, o AS (SELECT DISTINCT user_id FROM ev WHERE action = 'click' AND k < 5) SELECT user_id, 'old' AS v FROM o UNION ALL SELECT DISTINCT user_id, 'new' FROM ev WHERE action = 'view' AND user_id NOT IN (SELECT user_id FROM o)"),
}
