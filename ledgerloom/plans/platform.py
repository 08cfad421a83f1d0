"""Queries of search, platform statistics, audit activity, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators import platform as P
from ..operators.reconcile import near_days
from ..sources import views as V

L, E = f"WITH {V.LEDGER}", f"WITH {V.EVENTS}"


def _search(b):
    names = b.base.select("account_id").distinct().withColumn("name", F.concat(F.lit("Account "), F.col("account_id").cast("string")))
    return P.ledger_search(b.ledger, names, keyword="GEAR", txn_type="EXPENSE", date_from="1999-01-01", date_to="1999-12-31", amount_from=950, amount_to=1400)


def p1(b):
    return _search(b).select("txn_id", "user_id", "account_id", F.col("amount").cast("double").alias("amount"), F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"))


P1 = "txn_type = 'EXPENSE' AND txn_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND amount BETWEEN 950 AND 1400 AND (contains(lower(description), 'gear') OR contains(lower(merchant), 'gear') OR contains(lower('Account ' || account_id), 'gear'))"


def p14(b):
    found = _search(b)
    return P.page(found, P.sorted_ledger(found, "amount"), 1, 25).select("txn_id", F.col("amount").cast("double").alias("amount"))


def p2(b):
    return b.table("documents").where(F.contains(F.lower("text"), F.lit("50%_\\x".lower()))).agg(F.count("*").alias("hits"))


def p5(b):
    probe = b.ledger_events.select("account_id", "txn_date", "amount", "description")
    return b.ledger_events.join(probe.groupBy("account_id", "txn_date", "amount", "description").agg(F.count("*").alias("probes")), ["account_id", "txn_date", "amount", "description"]).select("txn_id", "probes")


def p6(b):
    probe = b.base.select("user_id", "amount", "txn_date").distinct()
    rows = b.ledger.where("txn_type = 'EXPENSE' and source != 'GMAIL_IMPORT'").select("user_id", "amount", "txn_date")
    return near_days(rows, probe, ["user_id", "amount"], 3, 3).groupBy(F.col("a.user_id").alias("user_id")).agg(F.count("*").alias("pairs"))


def p7(b):
    return b.table("customer").where(F.contains(F.lower("c_name"), F.lit("#00000012")) & (F.col("c_mktsegment") == "BUILDING")).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


def p8(b):
    return b.events.where("action like 'p%' and ts >= '2024-01-05' and ts < '2024-01-06'").select("event_id", "user_id", "action")


def p9(b):
    return b.table("events").where(F.get_json_object("props", "$.k") == "42").select("event_id", "user_id")


def p12(b):
    n = lambda c: F.count(F.when(c, 1))
    return b.ledger.groupBy("user_id").agg(n(F.col("needs_review")).alias("review"), n(F.col("duplicate_of").isNotNull()).alias("duplicates"), n(F.col("is_transfer")).alias("transfers"))


def p13(b):
    return b.ledger.join(b.ledger.where("status = 'REFUND'").select(F.col("refund_of").alias("id")).distinct(), F.col("txn_id") == F.col("id"), "left_semi").select("txn_id", "user_id")


def j1(b):
    orders, customer, nation, region = (b.table(t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy(F.coalesce("r_name", F.lit("Unknown")).alias("region"), F.coalesce("n_name", F.lit("Unknown")).alias("nation"), "o_orderstatus").agg(F.count("*").alias("orders"))


def j3(b):
    customer, orders = b.table("customer"), b.table("orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c_custkey").alias("users"), F.count_distinct("o_orderpriority").alias("priorities"))


def j5(b):
    users = b.table("customer").select(F.col("c_custkey").alias("user_id"))
    audit = b.events.where("action = 'purchase'").select("user_id")
    return P.inactive_users(users, audit)


def j5b(b):
    users = b.table("customer").select(F.col("c_custkey").alias("user_id"))
    audit = b.events.where("action = 'purchase'").select(F.when(F.col("k") > 5, F.col("user_id")).alias("user_id"))
    return P.inactive_users(users, audit)


def j16(b):
    parts, used, sold = b.table("part").select(F.col("p_partkey").alias("key")), b.table("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key")), b.table("lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("key"))
    return parts.join(used.union(sold).distinct(), "key", "left_anti")


def a21(b):
    return b.ledger.groupBy("account_id", "merchant").agg(F.count("*").alias("rows"), F.count(F.when(F.col("status") == "DUPLICATE", 1)).alias("duplicates"))


def a22(b):
    return P.status_counts(b.ledger)


def a23(b):
    return P.platform_spend(b.ledger, "merchant").withColumn("spent", F.col("spent").cast("double"))


def a24(b):
    return P.catalog(b.ledger)


def a25(b):
    return b.events.where("ts >= '2024-01-10' and ts < '2024-01-20'").groupBy("action").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("events"))


def a26(b):
    return P.overview(b.events, "2024-01-15")


def a27(b):
    return P.funnel(b.table("customer"), b.events)


def a28(b):
    return P.daily_activity(b.events, "2024-01-20").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def a29(b):
    n = lambda c: F.count(F.when(c, 1))
    return b.table("customer").agg(F.count("*").alias("users"), n(F.col("c_acctbal") < 0).alias("in_debt"), n(F.col("c_mktsegment") == "MACHINERY").alias("with_card"))


def a30(b):
    return P.workspace(b.ledger).withColumn("automation", F.round("automation", 4))


def a15(b):
    return b.imports.groupBy("bank").agg(F.count("*").alias("imports"), F.sum("rows").alias("imported"), F.max("day").alias("last_day"))


def a39(b):
    wide = b.events.groupBy((F.col("user_id") % 20).alias("domain")).pivot("action", ["purchase", "error", "view", "click"]).count().na.fill(0, ["purchase", "error", "view", "click"])
    tried = F.col("purchase") + F.col("error") + F.col("view")
    return wide.withColumn("success", F.round(F.when(tried > 0, F.col("purchase") / tried), 6))


def a40(b):
    return b.table("customer").join(b.table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("user_id")).agg(F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(14,2)")), F.lit(0)).cast("double").alias("balance"))


def a41(b):
    return b.ledger.groupBy("user_id").agg(F.date_format(F.min(F.when(F.col("needs_review"), F.col("txn_date"))), "yyyy-MM-dd").alias("oldest_pending"), F.date_format(F.max("txn_date"), "yyyy-MM-dd").alias("latest"))


def a42(b):
    return b.events.where("action = 'error'").groupBy("k").agg(dates.epoch(F.max("ts"), "MILLISECOND").alias("last_ms"), F.count("*").alias("n")).orderBy("last_ms", "k").limit(20)


def a43(b):
    return P.milestones(b.events).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss"))


def a44(b):
    kinds = b.accounts.groupBy("user_id").agg(F.max(F.when(F.col("account_type") == "CREDIT_CARD", 1).otherwise(0)).alias("card"))
    sign = F.when(F.col("txn_type") == "INCOME", 1).otherwise(-1) * F.when(F.col("card") == 1, -1).otherwise(1)
    return b.base.join(kinds, "user_id").groupBy("account_id").agg(F.sum(sign * F.col("amount")).cast("double").alias("delta"))


def a45(b):
    return b.base.groupBy("account_id", "ym").agg(F.sum(F.when(F.col("txn_type") == "INCOME", F.col("amount")).otherwise(0)).cast("double").alias("credits"), F.sum(F.when(F.col("txn_type") == "EXPENSE", F.col("amount")).otherwise(0)).cast("double").alias("debits"), F.date_format(F.min("txn_date"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("txn_date"), "yyyy-MM-dd").alias("last_date"), F.count_distinct("category").alias("categories"))


def a47(b):
    duplicates = b.ledger.where("status = 'DUPLICATE'").groupBy("account_id", "ym").agg(F.count("*").alias("duplicates"))
    statements = b.base.groupBy("account_id", "ym").agg(F.count("*").alias("rows")).join(duplicates, ["account_id", "ym"], "left")
    listed = F.sort_array(F.collect_list(F.struct("ym", "rows", F.coalesce("duplicates", F.lit(0)).alias("d"))), asc=False)
    return statements.groupBy("account_id").agg(F.count("*").alias("statements"), F.array_join(F.transform(F.slice(listed, 1, 3), lambda s: F.concat_ws(":", s["ym"], s["rows"], s["d"])), ",").alias("newest"))


def a48(b):
    latest = b.base.groupBy("account_id").agg(F.max_by("ym", F.struct("txn_date", "txn_id")).alias("latest"), F.count_distinct("ym").alias("statements"), F.count("*").alias("rows"))
    return b.accounts.where("account_type = 'SAVINGS'").select("account_key", (F.col("user_id") * 10).alias("account_id")).join(latest, "account_id", "left").select("account_key", "latest", F.coalesce("statements", F.lit(0)).alias("statements"), F.coalesce("rows", F.lit(0)).alias("rows"))


def a50(b):
    day = F.to_date(F.col("ts") + F.expr("interval 330 minutes"))
    return b.events.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def a51(b):
    recent = b.table("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    return recent.join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("user"), (F.col("o_orderstatus") == "P").alias("skipped"))


def a52(b):
    c = b.table("customer").select("c_custkey", "c_name", "c_nationkey")
    pairs = c.select(F.col("c_custkey").alias("referrer"), (F.col("c_custkey") + 1).alias("referred"))
    x, y = c.toDF("referrer", "from_name", "n1"), c.toDF("referred", "to_name", "n2")
    return pairs.join(x, "referrer", "left").join(y, "referred", "left").select("referrer", "referred", "from_name", "to_name", (F.col("n1") == F.col("n2")).alias("shared"))


def a53(b):
    last = b.ledger.orderBy(F.desc("txn_date"), "txn_id").limit(2000)
    pointers = last.select(F.explode(F.array_compact(F.array("duplicate_of", "refund_of"))).alias("pointer")).distinct()
    found = pointers.join(b.base.select(F.col("txn_id").alias("pointer")), "pointer", "left_semi").agg(F.count("*").alias("found"))
    return found.join(pointers.agg(F.count("*").alias("pointers")))


def a54(b):
    """Jobs (orders) and analyses (their lines), either of which may miss the other, with stages, findings and learning events."""
    jobs = b.table("orders").select(F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("trace"), "o_orderstatus")
    line = b.table("lineitem").select(F.when(F.col("l_quantity") > 45, F.col("l_orderkey") + 1_000_000_000_000).otherwise(F.col("l_orderkey")).alias("trace"), "l_linenumber", "l_returnflag", "l_quantity")
    analyses = line.groupBy("trace").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("rows"))
    stages = line.groupBy("trace").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: F.concat(s["l_linenumber"], F.lit(":"), s["l_returnflag"])), ",").alias("stages"))
    events = b.events.withColumn("trace", F.col("event_id"))
    findings = events.where("action = 'error'").groupBy("trace").agg(F.count("*").alias("findings"), F.max("k").alias("worst"))
    learnt = events.where("action in ('click', 'view')").groupBy("trace").agg(F.count("*").alias("learning_events"))
    return P.import_trace(jobs, analyses, stages, findings, learnt)


A54_SQL = f"""WITH {V.EVENTS}, j AS (SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey ELSE o_orderkey END AS trace, o_orderstatus FROM orders),
l AS (SELECT CASE WHEN l_quantity > 45 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS trace, * FROM lineitem),
s AS (SELECT trace, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS rows, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS stages FROM l GROUP BY 1),
t AS (SELECT coalesce(j.trace, s.trace) AS trace, o_orderstatus, lines, rows, stages FROM j FULL OUTER JOIN s ON j.trace = s.trace)
SELECT t.trace, o_orderstatus, lines, rows, stages, CAST(CASE WHEN action = 'error' THEN 1 ELSE 0 END AS BIGINT) AS findings, CASE WHEN action = 'error' THEN k END AS worst, CAST(CASE WHEN action IN ('click', 'view') THEN 1 ELSE 0 END AS BIGINT) AS learning_events FROM t LEFT JOIN ev ON ev.event_id = t.trace"""


def a55(b):
    delta = F.when(F.col("txn_type") == "INCOME", F.col("amount")).otherwise(-F.col("amount"))
    rows = b.base.withColumn("delta", delta)
    return P.goal_progress(rows, 3000).select("user_id", F.col("current").cast("double").alias("current"), F.date_format("completed_on", "yyyy-MM-dd").alias("completed_on"))


def w1(b):
    newest = Window.partitionBy("user_id", "action").orderBy(F.desc("ts"), "event_id")
    return b.events.withColumn("r", F.row_number().over(newest)).where("r = 1").select("user_id", "action", "event_id")


def w3(b):
    order = Window.partitionBy("user_id", "merchant").orderBy("txn_date", "txn_id")
    return b.base.select("txn_id", F.datediff("txn_date", F.lag("txn_date").over(order)).alias("gap"))


def w7(b):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return b.events.select("event_id", F.coalesce(F.col("action") != F.lag("action").over(order), F.lit(False)).alias("changed"))


def w12(b):
    n = b.events.groupBy("user_id", "action").agg(F.count("*").alias("n"))
    return n.select("user_id", "action", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6).alias("share"))


def o2(b):
    return b.ledger.where("txn_type = 'EXPENSE'").groupBy("user_id").agg(F.sum("amount").cast("double").alias("spent")).orderBy(F.desc("spent"), "user_id").limit(10)


def o3(b):
    return b.events.orderBy(F.desc("ts"), "event_id").limit(8).select("event_id", "action", "user_id")


def w8(b):
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return b.events.where("action = 'purchase'").withColumn("r", F.row_number().over(first)).where("r = 1").select("user_id", "event_id", "k")


def o7(b):
    rows = b.table("documents").select("doc_id", F.nullif(F.col("n_chars") % 7, F.lit(0)).alias("rate"))
    return rows.orderBy(F.asc_nulls_last("rate"), "doc_id").limit(50)


def u1(b):
    users = b.table("customer").where("lower(c_name) like '%0001%'").select(F.lit("user").alias("kind"), F.col("c_custkey").alias("id")).orderBy("id").limit(5)
    parts = b.table("part").where("lower(p_name) like '%ring%'").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id")).orderBy("id").limit(5)
    return P.hits(users, parts)


def u3(b):
    return b.table("part").select("p_brand", "p_type").distinct().exceptAll(b.base.where("qty > 48 and tax > 5").select(F.col("merchant").alias("p_brand"), F.col("category").alias("p_type")).distinct())


def u4(b):
    active = b.ledger.where("status = 'OK' and txn_type = 'EXPENSE'").select("txn_id")
    return b.ledger.where("is_recurring").join(active, "txn_id", "left_anti").select("txn_id", "status")


def u6(b):
    return b.base.select("user_id", "merchant").distinct()


def u7(b):
    done = b.events.where("action = 'signup'").select("user_id").distinct()
    return b.events.where("action = 'click' and k < 3").join(done, "user_id", "left_semi").select("event_id")


def u8(b):
    return b.events.select("user_id", "action", (F.col("k") % 4).alias("v")).dropDuplicates(["user_id", "action", "v"])


def q3(b):
    return b.events.where("action = 'error'").select("event_id", money.backoff_minutes(F.col("k") % 40).alias("minutes"), (F.col("k") % 40 >= 8).alias("dead"))


def q8(b):
    return b.ledger.where("txn_date < '1995-06-01' and needs_review").agg(F.count("*").alias("expired"))


CNT = "count(*) FILTER"
QUERIES = {
    "P1_ledger_search": (p1, f"{L} SELECT txn_id, user_id, account_id, CAST(amount AS DOUBLE) AS amount, strftime(txn_date, '%Y-%m-%d') AS txn_date FROM ledger WHERE {P1}"),
    "P2_literal_contains": (p2, "SELECT count(*) AS hits FROM documents WHERE contains(lower(text), '50%_\\x')"),
    "P5_duplicate_probe": (p5, f"WITH {V.LEDGER_EVENTS}, p AS (SELECT account_id, txn_date, amount, description, count(*) AS probes FROM le GROUP BY ALL) SELECT txn_id, probes FROM le JOIN p USING (account_id, txn_date, amount, description)"),
    "P6_candidate_window": (p6, f"{L}, p AS (SELECT DISTINCT user_id, amount, txn_date AS d FROM base) SELECT user_id, count(*) AS pairs FROM ledger JOIN p USING (user_id, amount) WHERE txn_type = 'EXPENSE' AND source <> 'GMAIL_IMPORT' AND txn_date BETWEEN d - 3 AND d + 3 GROUP BY 1"),
    "P7_user_search": (p7, "SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE contains(lower(c_name), '#00000012') AND c_mktsegment = 'BUILDING'"),
    "P8_audit_search": (p8, f"{E} SELECT event_id, user_id, action FROM ev WHERE action LIKE 'p%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"),
    "P9_json_path": (p9, "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'"),
    "P12_flag_counts": (p12, f"{L} SELECT user_id, {CNT} (needs_review) AS review, {CNT} (duplicate_of IS NOT NULL) AS duplicates, {CNT} (is_transfer) AS transfers FROM ledger GROUP BY 1"),
    "P13_referential_probe": (p13, f"{L} SELECT l.txn_id, l.user_id FROM ledger l JOIN (SELECT DISTINCT refund_of FROM ledger WHERE status = 'REFUND') r ON r.refund_of = l.txn_id"),
    "P14_O8_page": (p14, f"{L} SELECT txn_id, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE {P1} ORDER BY ledger.amount DESC, txn_id LIMIT 25 OFFSET 25"),
    "J1_enrichment": (j1, "SELECT coalesce(r_name, 'Unknown') AS region, coalesce(n_name, 'Unknown') AS nation, o_orderstatus, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"),
    "J3_distinct_through_join": (j3, "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS users, count(DISTINCT o_orderpriority) AS priorities FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "J5_inactive_users": (j5, "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')"),
    "J5_not_in_with_nulls": (j5b, f"{E} SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN k > 5 THEN user_id END FROM ev WHERE action = 'purchase')"),
    "J16_unreferenced": (j16, "SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)"),
    "A15_import_statistics": (a15, f"WITH {V.IMPORTS} SELECT bank, count(*) AS imports, CAST(sum(rows) AS BIGINT) AS imported, max(day) AS last_day FROM imports GROUP BY 1"),
    "A21_counts": (a21, f"{L} SELECT account_id, merchant, count(*) AS rows, {CNT} (status = 'DUPLICATE') AS duplicates FROM ledger GROUP BY 1, 2"),
    "A22_status_counts": (a22, f"{L} SELECT {CNT} (status = 'OK') AS ok, {CNT} (status = 'DUPLICATE') AS duplicate, {CNT} (status = 'TRANSFER') AS transfer, {CNT} (status = 'REFUND') AS refund, {CNT} (is_recurring) AS recurring FROM ledger"),
    "A23_platform_spend": (a23, f"{L} SELECT merchant, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS spent FROM ledger WHERE txn_type = 'EXPENSE' GROUP BY 1 ORDER BY sum(amount) DESC, merchant LIMIT 10"),
    "A24_merchant_catalog": (a24, f"{L} SELECT merchant, count(DISTINCT user_id) AS users, count(*) AS rows FROM ledger GROUP BY 1"),
    "A25_active_users": (a25, f"{E} SELECT action, count(DISTINCT user_id) AS users, count(*) AS events FROM ev WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1"),
    "A26_overview": (a26, f"{E}, s AS (SELECT {CNT} (d) AS events, {CNT} (NOT d) AS events_before, count(DISTINCT CASE WHEN d THEN user_id END) AS users, count(DISTINCT CASE WHEN NOT d THEN user_id END) AS users_before, {CNT} (d AND action = 'purchase') AS purchases, {CNT} (d AND action = 'error') AS errors FROM (SELECT *, CAST(ts AS DATE) = DATE '2024-01-15' AS d FROM ev WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-15')) SELECT *, events - events_before AS events_delta, users - users_before AS users_delta FROM s"),
    "A27_funnel": (a27, f"{E} SELECT 'all' AS step, count(*) AS users FROM customer UNION ALL SELECT action, count(DISTINCT user_id) FROM ev WHERE action IN ('signup', 'view', 'purchase') GROUP BY 1"),
    "A28_activity_trend": (a28, f"{E}, spine AS (SELECT DATE '2024-01-20' - CAST(i AS INT) AS day FROM range(7) t(i)), x AS (SELECT *, ts + INTERVAL 330 MINUTE AS l FROM ev) SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS events, count(DISTINCT user_id) AS users, {CNT} (action = 'error') AS errors FROM spine LEFT JOIN x ON l BETWEEN CAST(day AS TIMESTAMP) AND CAST(day + 1 AS TIMESTAMP) GROUP BY spine.day"),
    "A29_platform_overview": (a29, f"SELECT count(*) AS users, {CNT} (c_acctbal < 0) AS in_debt, {CNT} (c_mktsegment = 'MACHINERY') AS with_card FROM customer"),
    "A30_workspace": (a30, f"{L}, s AS (SELECT user_id, count(*) AS rows, {CNT} (decision_source = 'MANUAL') AS manual, {CNT} (needs_review) AS to_review, {CNT} (status = 'DUPLICATE') AS duplicates FROM ledger GROUP BY 1) SELECT *, round(floor((rows - manual) * 10000 / rows + 0.5) / 100, 4) AS automation FROM s"),
    "A39_parser_stats": (a39, f"{E}, w AS (SELECT user_id % 20 AS domain, " + ", ".join(f"{CNT} (action = '{a}') AS {a}" for a in ("purchase", "error", "view", "click")) + " FROM ev GROUP BY 1) SELECT *, round(CASE WHEN purchase + error + view > 0 THEN purchase / (purchase + error + view) END, 6) AS success FROM w"),
    "A40_wallet_balance": (a40, "SELECT c_custkey AS user_id, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS balance FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "A41_min_max_probes": (a41, f"{L} SELECT user_id, strftime(min(CASE WHEN needs_review THEN txn_date END), '%Y-%m-%d') AS oldest_pending, strftime(max(txn_date), '%Y-%m-%d') AS latest FROM ledger GROUP BY 1"),
    "A42_unreferenced_objects": (a42, f"{E} SELECT k, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM ev WHERE action = 'error' GROUP BY 1 ORDER BY last_ms, k LIMIT 20"),
    "A43_milestones": (a43, f"{E}, w AS (SELECT user_id, s AS step FROM (SELECT DISTINCT user_id FROM ev), (SELECT unnest(['signup', 'view', 'purchase']) AS s)) SELECT w.user_id, step, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at FROM w LEFT JOIN ev ON ev.user_id = w.user_id AND action = step GROUP BY 1, 2"),
    "A44_account_delta": (a44, f"WITH {V.BASE}, {V.ACCOUNTS}, c AS (SELECT user_id, max(CASE WHEN account_type = 'CREDIT_CARD' THEN 1 ELSE 0 END) AS card FROM accounts GROUP BY 1) SELECT account_id, CAST(sum((CASE WHEN txn_type = 'INCOME' THEN 1 ELSE -1 END) * (CASE WHEN card = 1 THEN -1 ELSE 1 END) * amount) AS DOUBLE) AS delta FROM base JOIN c USING (user_id) GROUP BY 1"),
    "A45_import_tally": (a45, f"WITH {V.BASE} SELECT account_id, ym, CAST(sum(CASE WHEN txn_type = 'INCOME' THEN amount ELSE 0 END) AS DOUBLE) AS credits, CAST(sum(CASE WHEN txn_type = 'EXPENSE' THEN amount ELSE 0 END) AS DOUBLE) AS debits, strftime(min(txn_date), '%Y-%m-%d') AS first_date, strftime(max(txn_date), '%Y-%m-%d') AS last_date, count(DISTINCT category) AS categories FROM base GROUP BY 1, 2"),
    "A47_statements_by_account": (a47, f"{L}, s AS (SELECT account_id, ym, count(*) AS n, {CNT} (status = 'DUPLICATE') AS d FROM ledger GROUP BY 1, 2) SELECT account_id, count(*) AS statements, array_to_string(list(ym || ':' || n || ':' || d ORDER BY ym DESC)[1:3], ',') AS newest FROM s GROUP BY 1"),
    "A48_account_cards": (a48, f"WITH {V.BASE}, {V.ACCOUNTS}, s AS (SELECT account_id, max(ym) AS latest, count(DISTINCT ym) AS statements, count(*) AS rows FROM base GROUP BY 1) SELECT account_key, latest, coalesce(statements, 0) AS statements, coalesce(rows, 0) AS rows FROM accounts LEFT JOIN s ON s.account_id = user_id * 10 WHERE account_type = 'SAVINGS'"),
    "A50_audit_timeline": (a50, f"{E} SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS events, min(event_id) AS first_event FROM ev GROUP BY 1"),
    "A51_recent_imports": (a51, "WITH r AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT o_orderkey, coalesce(c_name, 'unknown') AS user, o_orderstatus = 'P' AS skipped FROM r LEFT JOIN customer ON o_custkey = c_custkey"),
    "A52_referrals": (a52, "SELECT a.c_custkey AS referrer, a.c_custkey + 1 AS referred, a.c_name AS from_name, b.c_name AS to_name, a.c_nationkey = b.c_nationkey AS shared FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey + 1"),
    "A53_reference_check": (a53, f"{L}, r AS (SELECT * FROM ledger ORDER BY txn_date DESC, txn_id LIMIT 2000), p AS (SELECT duplicate_of AS pointer FROM r WHERE duplicate_of IS NOT NULL UNION SELECT refund_of FROM r WHERE refund_of IS NOT NULL) SELECT {CNT} (pointer IN (SELECT txn_id FROM base)) AS found, count(*) AS pointers FROM p"),
    "A54_import_trace": (a54, A54_SQL),
    "A55_goal_progress": (a55, f"WITH RECURSIVE {V.BASE}, r AS (SELECT user_id, txn_date, CASE WHEN txn_type = 'INCOME' THEN amount ELSE -amount END AS d, row_number() OVER (PARTITION BY user_id ORDER BY txn_date, txn_id) AS k FROM base), f AS (SELECT user_id, txn_date, k, CAST(greatest(0, d) AS DECIMAL(24,2)) AS c FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.txn_date, r.k, CAST(greatest(0, f.c + r.d) AS DECIMAL(24,2)) FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1) SELECT user_id, CAST(arg_max(c, k) AS DOUBLE) AS current, strftime(min(CASE WHEN c >= 3000 THEN txn_date END), '%Y-%m-%d') AS completed_on FROM f GROUP BY 1"),
    "W1_newest_wins": (w1, f"{E} SELECT user_id, action, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, action ORDER BY ts DESC, event_id) AS r FROM ev) WHERE r = 1"),
    "W3_day_gaps": (w3, f"WITH {V.BASE} SELECT txn_id, CAST(date_diff('day', lag(txn_date) OVER (PARTITION BY user_id, merchant ORDER BY txn_date, txn_id), txn_date) AS INT) AS gap FROM base"),
    "W7_changed": (w7, f"{E} SELECT event_id, coalesce(action <> lag(action) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM ev"),
    "W12_share": (w12, f"{E} SELECT user_id, action, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM ev GROUP BY 1, 2"),
    "O2_top_spenders": (o2, f"{L} SELECT user_id, CAST(sum(amount) AS DOUBLE) AS spent FROM ledger WHERE txn_type = 'EXPENSE' GROUP BY 1 ORDER BY spent DESC, user_id LIMIT 10"),
    "O3_recent_audit": (o3, f"{E} SELECT event_id, action, user_id FROM ev ORDER BY ts DESC, event_id LIMIT 8"),
    "W8_first_seen": (w8, f"{E} SELECT user_id, event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ev WHERE action = 'purchase') WHERE r = 1"),
    "O7_nulls_last": (o7, "SELECT doc_id, nullif(n_chars % 7, 0) AS rate FROM documents ORDER BY rate ASC NULLS LAST, doc_id LIMIT 50"),
    "U1_O4_union_of_hits": (u1, "SELECT * FROM (SELECT 'user' AS kind, c_custkey AS id FROM customer WHERE lower(c_name) LIKE '%0001%' ORDER BY id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'part', p_partkey AS id FROM part WHERE lower(p_name) LIKE '%ring%' ORDER BY id LIMIT 5)"),
    "U3_except": (u3, f"WITH {V.BASE} SELECT DISTINCT p_brand, p_type FROM part EXCEPT SELECT merchant, category FROM base WHERE qty > 48 AND tax > 5"),
    "U4_stale_recurring": (u4, f"{L} SELECT txn_id, status FROM ledger WHERE is_recurring AND NOT (status = 'OK' AND txn_type = 'EXPENSE')"),
    "U6_distinct": (u6, f"WITH {V.BASE} SELECT DISTINCT user_id, merchant FROM base"),
    "U7_already_processed": (u7, f"{E} SELECT event_id FROM ev WHERE action = 'click' AND k < 3 AND user_id IN (SELECT user_id FROM ev WHERE action = 'signup')"),
    "U8_identifier_merge": (u8, f"{E} SELECT DISTINCT user_id, action, k % 4 AS v FROM ev"),
    "Q3_backoff": (q3, f"{E} SELECT event_id, CAST(power(2, least(k % 40, 30)) AS BIGINT) AS minutes, k % 40 >= 8 AS dead FROM ev WHERE action = 'error'"),
    "Q8_expired": (q8, f"{L} SELECT count(*) AS expired FROM ledger WHERE txn_date < DATE '1995-06-01' AND needs_review"),
}
