"""Queries of reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..operators import rerun as RR
from ..sources import views as V

NORM = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
ROWS = ["txn_id", "user_id", "account_id", "txn_date", "amount", "txn_type", "description", "merchant"]


def _rows(b):
    return b.base.select(*ROWS, F.lit("OK").alias("status"))


def d1(b):
    return R.duplicates(b.ledger_events.withColumn("confirmed_at", F.when(F.col("user_id") % 10 == 0, F.col("created_at"))))


def d2_edges(b):
    return R.transfer_candidates(_rows(b)).select("user_id", "a_id", "b_id")


D2_SQL = f"""WITH {V.BASE}, r AS (SELECT *, {NORM.format('description')} AS norm FROM base)
SELECT a.user_id, a.txn_id AS a_id, b.txn_id AS b_id FROM r a JOIN r b ON a.user_id = b.user_id AND a.account_id <> b.account_id AND a.txn_type <> b.txn_type AND abs(a.amount - b.amount) < 1 AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 4
WHERE contains(a.norm, 'payment') AND NOT regexp_matches(a.norm, '\\b(salary|payroll|income tax refund|stipend)\\b') AND NOT regexp_matches(b.norm, '\\b(salary|payroll|income tax refund|stipend)\\b')"""


def d2(b):
    return R.transfers(R.transfer_candidates(_rows(b)))


def d3_edges(b):
    return R.refund_candidates(_rows(b)).select("income_id", "expense_id")


def d3_best(b):
    return R.best_refunds(R.refund_candidates(_rows(b)))


def d3(b):
    return R.refunds(R.refund_candidates(_rows(b)))


D3_EDGES = f"""{V.BASE}, r AS (SELECT *, {NORM.format('description')} AS norm FROM base),
edges AS (SELECT a.txn_id AS income_id, b.txn_id AS expense_id, a.amount AS ia, b.amount AS ea, date_diff('day', b.txn_date, a.txn_date) AS days, b.txn_date AS ed
  FROM r a JOIN r b ON a.user_id = b.user_id AND a.account_id = b.account_id AND a.txn_type = 'INCOME' AND b.txn_type = 'EXPENSE' AND date_diff('day', b.txn_date, a.txn_date) BETWEEN 0 AND 180 AND a.amount <= b.amount
  WHERE regexp_matches(a.norm, 'refund|reversal|returned|chargeback|credit adjustment|cancelled|canceled') OR lower(a.merchant) = lower(b.merchant))"""


# one user's pairs are tried in order: a pair is taken if neither end is in what was taken before
D2_PAIRS = f"""WITH RECURSIVE c AS ({D2_SQL}), base AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id, CAST(l_shipdate AS DATE) AS d FROM lineitem),
o AS (SELECT c.user_id, a_id, b_id, row_number() OVER (PARTITION BY c.user_id ORDER BY a.d, a_id, b.d, b_id) AS k FROM (SELECT DISTINCT * FROM c) c JOIN (SELECT DISTINCT * FROM base) a ON a.txn_id = a_id JOIN (SELECT DISTINCT * FROM base) b ON b.txn_id = b_id),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, []::VARCHAR[] AS used, false AS taken FROM o
  UNION ALL SELECT f.user_id, o.k, CASE WHEN list_contains(used, a_id) OR list_contains(used, b_id) THEN used ELSE list_concat(used, [a_id, b_id]) END, NOT (list_contains(used, a_id) OR list_contains(used, b_id)) FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT a_id, b_id FROM f JOIN o USING (user_id, k) WHERE taken"""
# one account's pairs in order: used holds an entry (purchase, amount) for each refund that was taken
D3_SQL = f"""WITH RECURSIVE {D3_EDGES}, n AS (SELECT DISTINCT txn_id, account_id, txn_date FROM base),
o AS (SELECT n.account_id, income_id, expense_id, ia, ea, row_number() OVER (PARTITION BY n.account_id ORDER BY n.txn_date, income_id, CASE WHEN ia = ea THEN 0 ELSE 1 END, days, ed, expense_id) AS k FROM edges JOIN n ON n.txn_id = income_id),
f AS (SELECT DISTINCT account_id, CAST(0 AS BIGINT) AS k, []::STRUCT(e VARCHAR, a DECIMAL(14,2))[] AS used, CAST(NULL AS VARCHAR) AS last, false AS taken FROM o
  UNION ALL SELECT t.account_id, t.k, CASE WHEN t.fits THEN list_append(used, {{'e': expense_id, 'a': ia}}) ELSE used END, CASE WHEN t.fits THEN income_id ELSE last END, t.fits
  FROM (SELECT f.used, f.last, o.*, last IS DISTINCT FROM income_id AND ia <= ea - coalesce(list_sum(list_transform(list_filter(used, lambda u: u.e = expense_id), lambda u: u.a)), 0) AS fits FROM f JOIN o ON o.account_id = f.account_id AND o.k = f.k + 1) t)
SELECT income_id, expense_id FROM f JOIN o USING (account_id, k) WHERE taken"""


def d4(b):
    rows = b.base.select(*ROWS)
    imports = rows.where("user_id % 10 = 3 and txn_date between '1998-03-01' and '1998-03-31'")
    return R.changes_near_import(rows, imports).groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("amount").cast("double").alias("total"))


def d5(b):
    rows = _rows(b)
    receipts = rows.where("merchant = 'Brand#7' and txn_type = 'EXPENSE'")
    return R.receipt_matches(receipts, rows.where("merchant != 'Brand#7'"))


D5_SQL = f"""WITH {V.BASE}, r AS (SELECT *, {NORM.format('description')} AS norm FROM base),
p AS (SELECT a.txn_id AS receipt_id, b.txn_id AS line_id, round(CASE WHEN greatest(length(a.norm), length(b.norm)) = 0 THEN 1.0 ELSE 1 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm)) END, 6) AS similarity, abs(date_diff('day', a.txn_date, b.txn_date)) AS days
  FROM r a JOIN r b ON a.user_id = b.user_id AND a.amount = b.amount AND abs(date_diff('day', a.txn_date, b.txn_date)) <= 3 WHERE a.merchant = 'Brand#7' AND a.txn_type = 'EXPENSE' AND b.merchant <> 'Brand#7'),
q AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY similarity DESC, days, line_id) AS place FROM p WHERE similarity >= 0.6)
SELECT receipt_id, line_id, similarity, CAST(days AS INT) AS days FROM q WHERE place = 1"""


def d6(b):
    status = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    return b.ledger.groupBy("account_id").agg(F.count("*").alias("rows"), status("DUPLICATE"), status("TRANSFER"), status("REFUND"), status("OK"))


def d7(b):
    return R.reset_pointers(b.ledger, b.ledger.where("ym = '1998-01' or user_id % 5 = 0"))


def d8(b):
    """Rows deleted and recategorised in bulk, then duplicates found anew."""
    left = b.ledger_events.where("merchant != 'view' or user_id % 4 != 0").withColumn("description", F.when(F.col("merchant") == "click", F.lit("view")).otherwise(F.col("description")))
    return R.duplicates(left.withColumn("confirmed_at", F.lit(None).cast("timestamp")))


def d8_incremental(b):
    """Some rows of every ledger are removed, moved by a month or renamed; the marks that this changes, from a run over the edited islands alone."""
    at = F.col("txn_date").cast("timestamp")
    # dealt by user once; each row then stands for itself before and, unless it is removed, after the edit
    rows = b.base.select(*ROWS, at.alias("created_at"), F.lit(None).cast("timestamp").alias("confirmed_at"), "qty", "tax").repartition("user_id").dropDuplicates(["user_id", "txn_id"])
    both = rows.withColumn("after", F.explode(F.when(F.expr("not (qty = 50 and tax = 0)"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    moved, renamed = F.expr("after and qty = 49 and tax = 1"), F.expr("after and qty = 48 and tax = 2")
    both = both.withColumn("txn_date", F.when(moved, F.date_add("txn_date", 30)).otherwise(F.col("txn_date"))).withColumn("description", F.when(renamed, "Card Payment moved").otherwise(F.col("description")))
    return RR.between(both.drop("qty", "tax"))


def j15(b):
    return R.dangling(b.ledger.where("user_id % 5 != 0 or txn_type = 'INCOME'"))


QUERIES = {
    "D1_duplicates": (d1, f"WITH {V.LEDGER_EVENTS}, m AS (SELECT *, first_value(txn_id) OVER (PARTITION BY account_id, txn_date, amount, description ORDER BY created_at, txn_id) AS original FROM le) SELECT txn_id, original AS duplicate_of FROM m WHERE original <> txn_id AND user_id % 10 <> 0"),
    "D2_transfer_candidates": (d2_edges, D2_SQL),
    "D2_transfers": (d2, D2_PAIRS),
    "D3_refund_candidates": (d3_edges, f"WITH {D3_EDGES} SELECT income_id, expense_id FROM edges"),
    "D3_best_refund": (d3_best, f"WITH {D3_EDGES}, q AS (SELECT *, row_number() OVER (PARTITION BY income_id ORDER BY CASE WHEN ia = ea THEN 0 ELSE 1 END, days, ed, expense_id) AS place FROM edges) SELECT income_id, expense_id FROM q WHERE place = 1"),
    "D3_refunds": (d3, D3_SQL),
    "D4_incremental_scope": (d4, f"WITH {V.BASE}, i AS (SELECT user_id, min(txn_date) - 180 AS lo, max(txn_date) + 180 AS hi FROM base WHERE user_id % 10 = 3 AND txn_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' GROUP BY 1) SELECT user_id, count(*) AS rows, CAST(sum(amount) AS DOUBLE) AS total FROM base JOIN i USING (user_id) WHERE txn_date BETWEEN lo AND hi GROUP BY 1"),
    "D5_receipt_match": (d5, D5_SQL),
    "D6_import_tally": (d6, f"WITH {V.LEDGER} SELECT account_id, count(*) AS rows, count(*) FILTER (status = 'DUPLICATE') AS duplicate, count(*) FILTER (status = 'TRANSFER') AS transfer, count(*) FILTER (status = 'REFUND') AS refund, count(*) FILTER (status = 'OK') AS ok FROM ledger GROUP BY 1"),
    "D7_pointer_reset": (d7, f"WITH {V.LEDGER}, g AS MATERIALIZED (SELECT DISTINCT txn_id FROM ledger WHERE ym = '1998-01' OR user_id % 5 = 0) SELECT l.txn_id, 'OK' AS status, status AS was FROM ledger l ANTI JOIN g ON g.txn_id = l.txn_id SEMI JOIN g h ON h.txn_id = coalesce(l.duplicate_of, l.refund_of)"),
    "D8_incremental_rerun": (d8_incremental, None),
    "D8_bulk_change_and_rerun": (d8, f"WITH {V.LEDGER_EVENTS}, x AS (SELECT * REPLACE (CASE WHEN merchant = 'click' THEN 'view' ELSE description END AS description) FROM le WHERE merchant <> 'view' OR user_id % 4 <> 0), m AS (SELECT *, first_value(txn_id) OVER (PARTITION BY account_id, txn_date, amount, description ORDER BY created_at, txn_id) AS original FROM x) SELECT txn_id, original AS duplicate_of FROM m WHERE original <> txn_id"),
    "J15_dangling_pointers": (j15, f"WITH {V.LEDGER}, r AS (SELECT * FROM ledger WHERE user_id % 5 <> 0 OR txn_type = 'INCOME') SELECT 'duplicate_of' AS pointer, count(*) AS dangling FROM r WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT txn_id FROM r) UNION ALL SELECT 'refund_of', count(*) FROM r WHERE refund_of IS NOT NULL AND refund_of NOT IN (SELECT txn_id FROM r)"),
}
