"""Queries of user analytics: netting, dashboards, reports, health, insights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources import views as V

MONTH = "2000-12"
NET = """off AS (SELECT refund_of AS purchase_id, sum(amount) AS refunded FROM ledger WHERE status = 'REFUND' AND refund_of IS NOT NULL GROUP BY 1),
net AS (SELECT l.*, CASE WHEN txn_type = 'EXPENSE' THEN greatest(0, coalesce(amount, 0) - coalesce(refunded, 0)) ELSE coalesce(amount, 0) END AS net
  FROM ledger l LEFT JOIN off ON l.txn_id = off.purchase_id WHERE duplicate_of IS NULL AND NOT is_transfer AND status <> 'REFUND')"""
MONTHLY = "monthly AS (SELECT user_id, ym, sum(CASE WHEN txn_type = 'INCOME' THEN net ELSE 0 END) AS income, sum(CASE WHEN txn_type = 'EXPENSE' THEN net ELSE 0 END) AS expense, count(*) AS rows FROM net GROUP BY 1, 2)"
HEAD = f"WITH {V.LEDGER}, {NET}"
D = lambda c: F.col(c).cast("double").alias(c)


def _doubles(df, *names):
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def p3(b):
    rows = b.ledger.groupBy("status", "txn_type").agg(F.count("*").alias("rows"), F.sum("amount").cast("double").alias("total"))
    good = A.reportable(b.ledger).groupBy("status", "txn_type").agg(F.count("*").alias("reportable"))
    return rows.join(good, ["status", "txn_type"], "left").withColumn("reportable", F.coalesce("reportable", F.lit(0)))


def a1(b):
    return _doubles(A.refund_offsets(b.ledger), "refunded")


def a2(b):
    return A.netted(b.ledger).groupBy("user_id", "txn_type").agg(F.sum("net").cast("double").alias("net"), F.sum("amount").cast("double").alias("raw"), F.count("*").alias("rows"))


def a3(b):
    return _doubles(A.monthly(b.ledger), "income", "expense")


def a4(b):
    d = A.dashboard(b.ledger, MONTH)
    return _doubles(d, "income", "expense", "prior_income", "prior_expense").withColumns({c: F.round(c, 4) for c in ("income_change", "expense_change", "savings_rate")})


A4_SQL = f"""{HEAD}, {MONTHLY}, period AS (SELECT user_id, max(ym) AS ym FROM monthly WHERE ym <= '{MONTH}' GROUP BY 1),
p AS (SELECT *, strftime(CAST(ym || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS prior_ym FROM period),
s AS (SELECT p.user_id, p.ym, p.prior_ym, p.ym = '{MONTH}' AS is_current, CAST(n.income AS DOUBLE) AS income, CAST(n.expense AS DOUBLE) AS expense, CAST(coalesce(o.income, 0) AS DOUBLE) AS prior_income, CAST(coalesce(o.expense, 0) AS DOUBLE) AS prior_expense
  FROM p JOIN monthly n ON n.user_id = p.user_id AND n.ym = p.ym LEFT JOIN monthly o ON o.user_id = p.user_id AND o.ym = p.prior_ym)
SELECT *, CASE WHEN prior_income <> 0 THEN round(round((income - prior_income) / abs(prior_income), 6) * 100, 4) END AS income_change,
  CASE WHEN prior_expense <> 0 THEN round(round((expense - prior_expense) / abs(prior_expense), 6) * 100, 4) END AS expense_change,
  CASE WHEN income > 0 THEN round(round((income - expense) / income, 4) * 100, 4) ELSE 0.0 END AS savings_rate FROM s"""


def a6(b):
    return _doubles(A.spend_by(b.ledger, "category", F.col("ym") == MONTH), "spent")


def a8(b):
    return _doubles(A.balances(b.accounts), "savings", "wallet", "investment", "card_debt", "assets", "net_worth")


def a9(b):
    return A.health(b.ledger, b.accounts).withColumns({c: F.floor(F.col(c) * 1000 + 0.5) / 1000 for c in ("savings", "debt", "emergency", "consistency", "cash_flow")})


A9_SQL = f"""{HEAD}, {MONTHLY}, {V.ACCOUNTS},
m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ym DESC) AS age, sum(rows) OVER (PARTITION BY user_id) AS all_rows FROM monthly),
r AS (SELECT user_id, age, CAST(income AS DOUBLE) AS i, CAST(expense AS DOUBLE) AS e, round(avg(CAST(expense AS DOUBLE)) OVER (PARTITION BY user_id), 6) AS mean FROM m WHERE all_rows >= 10 AND age <= 6),
s AS (SELECT user_id, count(*) AS n, max(mean) AS mean, avg((e - mean) * (e - mean)) AS v, avg(CASE WHEN i >= e THEN 1.0 ELSE 0.0 END) AS good, max(CASE WHEN age = 1 THEN i END) AS li, max(CASE WHEN age = 1 THEN e END) AS le FROM r GROUP BY 1),
cards AS (SELECT user_id, avg(round(CAST(balance AS DOUBLE) / CAST(credit_limit AS DOUBLE), 6)) AS used FROM accounts WHERE account_type = 'CREDIT_CARD' AND credit_limit > 0 GROUP BY 1),
liquid AS (SELECT user_id, CAST(sum(balance) AS DOUBLE) AS liquid FROM accounts WHERE account_type IN ('SAVINGS', 'WALLET') GROUP BY 1),
f AS (SELECT s.user_id, least(greatest(CASE WHEN li > 0 THEN round((li - le) / li, 4) * 100 ELSE 0 END, 0), 30) / 30 * 100 AS savings, CASE WHEN used IS NULL THEN 100.0 ELSE greatest(0, 100 - used * 100) END AS debt,
  least(CASE WHEN mean = 0 THEN CASE WHEN coalesce(liquid, 0) > 0 THEN 6.0 ELSE 0.0 END ELSE coalesce(liquid, 0) / mean END / 6, 1) * 100 AS emergency,
  greatest(0, 100 - least(CASE WHEN n < 2 OR mean = 0 THEN 0 ELSE sqrt(v) / mean END * 100, 100)) AS consistency, good * 100 AS cash_flow
  FROM s LEFT JOIN cards USING (user_id) LEFT JOIN liquid USING (user_id)),
g AS (SELECT *, CAST(floor(0.25 * savings + 0.20 * debt + 0.25 * emergency + 0.15 * consistency + 0.15 * cash_flow + 0.5) AS BIGINT) AS score FROM f)
SELECT user_id, floor(savings * 1000 + 0.5) / 1000 AS savings, floor(debt * 1000 + 0.5) / 1000 AS debt, floor(emergency * 1000 + 0.5) / 1000 AS emergency, floor(consistency * 1000 + 0.5) / 1000 AS consistency, floor(cash_flow * 1000 + 0.5) / 1000 AS cash_flow, score,
  CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Fair' ELSE 'Needs Attention' END AS label FROM g"""


def a10(b):
    return A.reporting_period(A.monthly(b.ledger), MONTH)


def a11(b):
    return _doubles(A.top_per_user(A.spend_by(b.ledger, "merchant", unknown="Unknown"), "merchant", 10), "spent")


def a12(b):
    return _doubles(A.top_per_user(A.spend_by(b.ledger, "category", F.col("ym") >= "2000-01"), "category", 10), "spent")


TOP_SQL = """{head}, s AS (SELECT user_id, {key}, sum(net) AS spent, count(*) AS rows FROM net WHERE txn_type = 'EXPENSE'{where} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spent DESC, {key}) AS place FROM s)
SELECT user_id, {key}, CAST(spent AS DOUBLE) AS spent, rows, place FROM r WHERE place <= 10"""


def a13(b):
    return _doubles(A.merchant_trend(b.ledger, MONTH), "spent")


A13_SQL = f"""{HEAD}, r AS (SELECT * FROM net WHERE txn_type = 'EXPENSE' AND ym BETWEEN '2000-07' AND '{MONTH}'),
spine AS (SELECT user_id, merchant, ym FROM (SELECT DISTINCT user_id, merchant FROM r), (SELECT strftime(DATE '2000-07-01' + INTERVAL (i) MONTH, '%Y-%m') AS ym FROM range(6) t(i))),
s AS (SELECT user_id, merchant, ym, sum(net) AS spent FROM r GROUP BY ALL)
SELECT user_id, merchant, ym, CAST(coalesce(spent, 0) AS DOUBLE) AS spent FROM spine LEFT JOIN s USING (user_id, merchant, ym)"""


def a17(b):
    return _doubles(A.monthly_report(b.ledger, MONTH), "income", "expense", "spent")


A17_SQL = f"""{HEAD}, m AS (SELECT * FROM net WHERE ym = '{MONTH}'),
t AS (SELECT user_id, sum(CASE WHEN txn_type = 'INCOME' THEN net ELSE 0 END) AS income, sum(CASE WHEN txn_type = 'EXPENSE' THEN net ELSE 0 END) AS expense FROM m GROUP BY 1),
c AS (SELECT user_id, coalesce(category, 'Uncategorized') AS category, sum(net) AS spent FROM m WHERE txn_type = 'EXPENSE' GROUP BY 1, 2)
SELECT user_id, CAST(income AS DOUBLE) AS income, CAST(expense AS DOUBLE) AS expense, category, CAST(spent AS DOUBLE) AS spent FROM t LEFT JOIN c USING (user_id)"""


def a18(b):
    return A.reportable(b.ledger).select("user_id", "ym").distinct()


def a19(b):
    return A.movers(b.ledger, MONTH).withColumn("pct", F.round("pct", 4))


MOVERS = f"""sp AS (SELECT user_id, ym, category, sum(net) AS spent FROM net WHERE txn_type = 'EXPENSE' AND ym <= '{MONTH}' GROUP BY ALL),
ag AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ym DESC) AS age FROM sp),
ag4 AS (SELECT *, max(age) OVER (PARTITION BY user_id) - 1 AS n_prior FROM ag WHERE age <= 4),
mv AS (SELECT user_id, category, n_prior, CAST(sum(CASE WHEN age = 1 THEN spent END) AS DOUBLE) AS now, CAST(sum(CASE WHEN age > 1 THEN spent END) AS DOUBLE) AS b4 FROM ag4 GROUP BY ALL),
mp AS (SELECT user_id, category, now, round(coalesce(b4, 0) / greatest(n_prior, 1), 4) AS prior_average FROM mv WHERE now IS NOT NULL),
movers AS (SELECT *, CASE WHEN prior_average > 0 THEN round((now - prior_average) / prior_average, 6) * 100 END AS pct FROM mp)"""


def a19b(b):
    return A.insights(b.ledger, b.budgets, MONTH)


A19_SENTENCES = f"""{HEAD}, {MOVERS}, {V.BUDGETS}, st AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(pct) DESC, category) AS r FROM movers WHERE abs(coalesce(pct, 0)) >= 15),
nu AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r) AS q FROM st ANTI JOIN budgets USING (user_id, category)),
big AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY now DESC, category) AS r FROM movers)
SELECT user_id, 1 AS place, 'You spent ₹' || format('{{:,}}', CAST(round(sum(CAST(now AS DECIMAL(14,2)))) AS BIGINT)) || ' this month.' AS sentence FROM movers GROUP BY 1
UNION ALL SELECT user_id, 2, 'Biggest category: ' || category || ' at ₹' || format('{{:,}}', CAST(round(now) AS BIGINT)) || '.' FROM big WHERE r = 1
UNION ALL SELECT user_id, 3, 'Consider a budget for ' || category || '.' FROM nu WHERE q = 1
UNION ALL SELECT user_id, r + 3, category || CASE WHEN pct > 0 THEN ' is up ' ELSE ' is down ' END || CAST(round(abs(pct)) AS BIGINT) || '% on your average.' FROM st WHERE r <= 3"""


def a20(b):
    spend = b.ledger.where("txn_type = 'EXPENSE' and not is_transfer and duplicate_of is null").where(F.col("ym") == MONTH).groupBy("user_id", "category").agg(F.sum("amount").alias("spent"))
    return _doubles(A.budget_status(b.budgets, spend), "limit_amount", "spent").withColumn("used", F.round("used", 4))


def a7(b):
    spend = A.netted(b.ledger).where((F.col("txn_type") == "EXPENSE") & (F.col("ym") == MONTH)).groupBy("user_id", "category").agg(F.sum("net").alias("spent"))
    return _doubles(A.budget_status(b.budgets, spend), "limit_amount", "spent").withColumn("used", F.round("used", 4))


BUDGET_SQL = """{head}, {budgets}, s AS (SELECT user_id, category, sum({amount}) AS spent FROM {rows} AND ym = '2000-12' GROUP BY 1, 2)
SELECT user_id, category, CAST(limit_amount AS DOUBLE) AS limit_amount, CAST(coalesce(spent, 0) AS DOUBLE) AS spent, round(floor(CAST(coalesce(spent, 0) AS DOUBLE) * 10000 / CAST(limit_amount AS DOUBLE) + 0.5) / 10000 * 100, 4) AS used FROM budgets LEFT JOIN s USING (user_id, category)"""


def a49(b):
    return _doubles(A.fold_rest(A.spend_by(b.ledger, "merchant"), "merchant", 5), "spent")


def r1(b):
    """A merchant's charges of one year are a series of their own."""
    rows = b.ledger.withColumn("merchant", F.concat_ws(" ", "merchant", F.substring("ym", 1, 4)))
    return A.recurring(rows).withColumn("next_date", F.date_format("next_date", "yyyy-MM-dd")).withColumn("avg_gap", F.round("avg_gap", 6))


R1_SQL = f"""WITH {V.LEDGER}, l AS (SELECT * REPLACE (merchant || ' ' || ym[1:4] AS merchant) FROM ledger),
a AS (SELECT *, date_diff('day', lag(txn_date) OVER (PARTITION BY user_id, merchant ORDER BY txn_date, txn_id), txn_date) AS gap FROM l WHERE duplicate_of IS NULL AND NOT is_transfer AND txn_type = 'EXPENSE'),
m AS (SELECT *, avg(gap) OVER w AS avg_gap, round(CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w, 4) AS avg_amount FROM a WINDOW w AS (PARTITION BY user_id, merchant)),
g AS (SELECT user_id, merchant, count(*) AS rows, max(avg_gap) AS avg_gap, max(avg_amount) AS avg_amount, max(txn_date) AS last_date,
  bool_and(coalesce(abs(gap - avg_gap) <= greatest(5.0, 0.35 * avg_gap), true) AND abs(CAST(amount AS DOUBLE) - avg_amount) <= 0.2 * avg_amount + 1) AS ok FROM m GROUP BY 1, 2)
SELECT user_id, merchant, rows, round(avg_gap, 6) AS avg_gap, avg_amount, CASE WHEN avg_gap < 10 THEN 'Weekly' WHEN avg_gap < 20 THEN 'Biweekly' WHEN avg_gap < 40 THEN 'Monthly' ELSE 'Quarterly' END AS label,
  strftime(last_date + CAST(floor(avg_gap + 0.5) AS INT), '%Y-%m-%d') AS next_date FROM g WHERE rows >= 3 AND ok AND avg_gap BETWEEN 5 AND 95"""


def o5(b):
    """Each user's recurring charges in the order in which the next is due."""
    order = Window.partitionBy("user_id").orderBy("next_date", "merchant")
    return r1(b).select("user_id", "merchant", "next_date", F.row_number().over(order).alias("place"))


def notify(b):
    return A.notifications(b.ledger, b.accounts, b.budgets, MONTH)


QUERIES = {
    "P3_reportable": (p3, f"""WITH {V.LEDGER} SELECT status, txn_type, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS total, count(*) FILTER (duplicate_of IS NULL AND NOT is_transfer AND status <> 'REFUND') AS reportable FROM ledger GROUP BY 1, 2"""),
    "A1_refund_offsets": (a1, f"{HEAD} SELECT purchase_id, CAST(refunded AS DOUBLE) AS refunded FROM off"),
    "A2_reportable_amount": (a2, f"{HEAD} SELECT user_id, txn_type, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(amount) AS DOUBLE) AS raw, count(*) AS rows FROM net GROUP BY 1, 2"),
    "A3_month_type_sums": (a3, f"{HEAD}, {MONTHLY} SELECT user_id, ym, CAST(income AS DOUBLE) AS income, CAST(expense AS DOUBLE) AS expense, rows FROM monthly"),
    "A4_A5_dashboard": (a4, A4_SQL),
    "A6_spend_by_category": (a6, f"{HEAD} SELECT user_id, category, CAST(sum(net) AS DOUBLE) AS spent, count(*) AS rows FROM net WHERE txn_type = 'EXPENSE' AND ym = '{MONTH}' GROUP BY 1, 2"),
    "A7_budget_alerts": (a7, BUDGET_SQL.format(head=HEAD, budgets=V.BUDGETS, amount="net", rows="net WHERE txn_type = 'EXPENSE'")),
    "A8_balances": (a8, f"WITH {V.ACCOUNTS}, s AS (SELECT user_id, " + ", ".join(f"sum(CASE WHEN account_type = '{k}' THEN balance ELSE 0 END) AS {n}" for k, n in (("SAVINGS", "savings"), ("WALLET", "wallet"), ("INVESTMENT", "investment"), ("CREDIT_CARD", "card_debt"))) + " FROM accounts GROUP BY 1) SELECT user_id, CAST(savings AS DOUBLE) AS savings, CAST(wallet AS DOUBLE) AS wallet, CAST(investment AS DOUBLE) AS investment, CAST(card_debt AS DOUBLE) AS card_debt, CAST(savings + wallet + investment AS DOUBLE) AS assets, CAST(savings + wallet + investment - card_debt AS DOUBLE) AS net_worth FROM s"),
    "A9_health_score": (a9, A9_SQL),
    "A10_reporting_period": (a10, f"{HEAD}, {MONTHLY}, p AS (SELECT user_id, max(ym) AS ym FROM monthly WHERE ym <= '{MONTH}' GROUP BY 1) SELECT user_id, ym, ym = '{MONTH}' AS is_current, strftime(CAST(ym || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS prior_ym FROM p"),
    "A11_top_merchants": (a11, TOP_SQL.format(head=HEAD, key="merchant", where="")),
    "A12_top_categories": (a12, TOP_SQL.format(head=HEAD, key="category", where=" AND ym >= '2000-01'")),
    "A13_merchant_trend": (a13, A13_SQL),
    "A17_monthly_report": (a17, A17_SQL),
    "A18_available_months": (a18, f"{HEAD} SELECT DISTINCT user_id, ym FROM net"),
    "A19_movers": (a19, f"{HEAD}, {MOVERS} SELECT user_id, category, now, prior_average, round(pct, 4) AS pct FROM movers"),
    "A19_insight_sentences": (a19b, A19_SENTENCES),
    "A20_budget_vs_spend": (a20, BUDGET_SQL.format(head=HEAD, budgets=V.BUDGETS, amount="amount", rows="ledger WHERE txn_type = 'EXPENSE' AND NOT is_transfer AND duplicate_of IS NULL")),
    "A49_top_n_and_other": (a49, f"""{HEAD}, s AS (SELECT user_id, merchant, sum(net) AS spent FROM net WHERE txn_type = 'EXPENSE' GROUP BY 1, 2),
r AS (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY spent DESC, merchant) <= 5 THEN merchant ELSE 'Other' END AS label, spent FROM s), g AS (SELECT user_id, label, sum(spent) AS spent FROM r GROUP BY 1, 2)
SELECT user_id, label, CAST(spent AS DOUBLE) AS spent, round(CAST(spent AS DOUBLE) / CAST(sum(spent) OVER (PARTITION BY user_id) AS DOUBLE) * 100, 4) AS share FROM g"""),
    "R1_recurring": (r1, R1_SQL),
    "O5_recurring_by_next_date": (o5, f"SELECT user_id, merchant, next_date, row_number() OVER (PARTITION BY user_id ORDER BY next_date, merchant) AS place FROM ({R1_SQL})"),
    "N_notifications": (notify, f"""{HEAD}, {V.ACCOUNTS}, {V.BUDGETS}, s AS (SELECT user_id, category, sum(net) AS spent FROM net WHERE txn_type = 'EXPENSE' AND ym = '{MONTH}' GROUP BY 1, 2)
SELECT user_id, 'LOW_BALANCE' AS kind, '' AS category, count(*) AS n FROM accounts WHERE account_type IN ('SAVINGS', 'WALLET') AND balance < 500 GROUP BY 1 UNION ALL SELECT user_id, 'BUDGET', category, 1 FROM budgets JOIN s USING (user_id, category) WHERE limit_amount > 0 AND spent >= limit_amount"""),
}
