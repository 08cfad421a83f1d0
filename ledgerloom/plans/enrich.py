"""Queries of text functions, rules, merchants and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich as N
from ..operators import institutions
from ..operators import products as P
from ..sources import views as V
from .reconcile import NORM

TOK = "list_filter(string_split({0}, ' '), lambda t: t <> '')"
# The fixed values once more, for the SQL alone: a wrong entry on either side shows.
RAIL = """['upi', 'neft', 'imps', 'rtgs', 'ach', 'nach', 'ecs', 'eft', 'clg', 'byclg', 'atm', 'pos', 'chq', 'cheque', 'inb', 'tpt', 'ift',
  'mmt', 'vps', 'wdl', 'payment', 'transfer', 'withdrawal', 'purchase', 'txn', 'trf', 'ref']"""
NAMED = f"list_filter(string_split({{0}}, ' '), lambda t: t <> '' AND NOT list_contains({RAIL}, t))"
SIGNIFICANT = f"coalesce(list_filter({NAMED}, lambda t: length(t) > 2)[1], ({NAMED})[1])"
KEYWORD = r"""CASE WHEN regexp_matches({0}, '\b(salary|payroll|income tax refund|stipend)\b') THEN 'Salary'
  WHEN regexp_matches({0}, '\b(house rent|rent paid|rent payment|monthly rent|rent due|landlord|housing society|maintenance chg)\b') THEN 'Rent'
  WHEN regexp_matches({0}, '\b(bigbasket|blinkit|zepto|grofers|dmart|grocery|supermarket)\b') THEN 'Groceries'
  WHEN regexp_matches({0}, '\b(swiggy|zomato|restaurant|cafe|starbucks|dominos|mcdonald|kfc)\b') THEN 'Dining'
  WHEN regexp_matches({0}, '\b(uber|ola|rapido|irctc|petrol|fuel|metro|fastag|parking)\b') THEN 'Transport'
  WHEN regexp_matches({0}, '\b(electricity|power bill|water bill|gas bill|broadband|airtel|jio|recharge)\b') THEN 'Utilities'
  WHEN regexp_matches({0}, '\b(amazon|flipkart|myntra|ajio|nykaa|decathlon)\b') THEN 'Shopping'
  WHEN regexp_matches({0}, '\b(pharmacy|apollo|medplus|hospital|clinic|netmeds|1mg)\b') THEN 'Health'
  WHEN regexp_matches({0}, '\b(netflix|prime video|hotstar|spotify|bookmyshow|pvr|inox)\b') THEN 'Entertainment'
  WHEN regexp_matches({0}, '\b(mutual fund|sip|zerodha|groww|upstox|nps|ppf|demat)\b') THEN 'Investments'
  WHEN regexp_matches({0}, '\b(annual fee|late fee|finance charge|interest charged|penalty)\b') THEN 'Fees/Interest'
  WHEN regexp_matches({0}, '\b(credit card payment|card bill payment|autopay|neft to|imps to|billdesk)\b') THEN 'Transfer'
  WHEN regexp_matches({0}, '\b(loan emi|emi payment|emi deduction|personal loan|home loan|car loan|auto loan)\b') THEN 'Loan EMI'
  WHEN regexp_matches({0}, '\b(insurance|lic premium|policybazaar|premium payment)\b') THEN 'Insurance'
  WHEN regexp_matches({0}, '\b(atm withdrawal|atm wdl|cash withdrawal|cash wdl)\b') THEN 'Cash Withdrawal'
  WHEN regexp_matches({0}, '\b(makemytrip|goibibo|yatra|airbnb|oyo|indigo|spicejet|vistara|hotel booking)\b') THEN 'Travel'
  WHEN regexp_matches({0}, '\b(google one|icloud|adobe|microsoft 365|linkedin premium)\b') THEN 'Subscriptions'
  WHEN regexp_matches({0}, '\b(udemy|coursera|byjus|tuition fee|school fee|college fee)\b') THEN 'Education'
  WHEN regexp_matches({0}, '\b(donation|charity|ngo donation|gift)\b') THEN 'Gifts & Donations' ELSE 'Other' END"""
REFUND = "refund|reversal|returned|chargeback|credit adjustment|cancelled|canceled"
#: What is put behind descriptions, by quantity, so that every kind of keyword, and words that only look like one, occur.
SAID = [
    "", "income tax refund", "RENT-PAID may", "BigBasket 99", "current account", "ola*trip", "cola", "Amazon.in", "mutual fund SIP", "premium academic", "loan emi 7/12", "LIC premium", "ATM WDL", "hotel  booking",
    "microsoft 365", "school fee", "gift", "water bill", "neft to x", "late fee", "netflix", "apollo clinic", "kfc", "bingo",
]
SAID_SQL = "description || ' ' || [" + ", ".join(f"'{x}'" for x in SAID) + f"][qty % {len(SAID)} + 1]"


def _said():
    return F.concat("description", F.lit(" "), F.element_at(F.array(*map(F.lit, SAID)), F.col("qty") % len(SAID) + 1))


LEARN = f"{V.EVENTS}, {V.LEARNING}"
TOP = "tl AS (SELECT user_id, merchant, category_id, confirmations, CAST(floor(confirmations * 100 / total + 0.5) AS BIGINT) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, merchant ORDER BY confirmations DESC, last_at DESC, category_id) AS place, sum(confirmations) OVER (PARTITION BY user_id, merchant) AS total FROM learning) WHERE place = 1)"
HOLDS = """CASE WHEN operator = 'CONTAINS' THEN contains(lower(f), lower(value)) WHEN operator = 'STARTS_WITH' THEN starts_with(lower(f), lower(value))
  WHEN operator = 'EQUALS' AND field = 'AMOUNT' THEN amount = TRY_CAST(value AS DECIMAL(14,2)) WHEN operator = 'EQUALS' THEN lower(f) = lower(value)
  WHEN operator = 'GREATER_THAN' THEN amount > TRY_CAST(value AS DECIMAL(14,2)) WHEN operator = 'LESS_THAN' THEN amount < TRY_CAST(value AS DECIMAL(14,2))
  WHEN operator = 'BETWEEN' THEN amount BETWEEN TRY_CAST(string_split(value, ',')[1] AS DECIMAL(14,2)) AND TRY_CAST(string_split(value, ',')[2] AS DECIMAL(14,2)) ELSE false END"""
MATCHES = f"""{V.BASE}, {V.RULES_SQL}, mt AS (SELECT * FROM (SELECT b.*, r.*, CASE field WHEN 'DESCRIPTION' THEN description WHEN 'MERCHANT' THEN merchant ELSE CAST(amount AS VARCHAR) END AS f FROM base b, rules r WHERE rule_user IS NULL OR rule_user = user_id) WHERE coalesce({HOLDS}, false))"""
WON = "won AS (SELECT txn_id, rule_id, target FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY CASE WHEN scope = 'USER' THEN 0 ELSE 1 END, priority, rule_id) AS place FROM mt WHERE action = 'ASSIGN_CATEGORY') WHERE place = 1)"


def f_text(b):
    texts = b.table("documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))
    return texts.select("doc_id", "norm", T.merchant_of(F.col("norm")).alias("merchant"), T.token_of(F.col("norm")).alias("token"), T.category_of(F.col("norm")).alias("keyword"), T.refund_in(F.col("norm")).alias("refund"))


F_TEXT = f"""WITH d AS (SELECT doc_id, {NORM.format('text')} AS n FROM documents),
c AS (SELECT *, list_filter(string_split(n, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[a-z]*[0-9]{{4,}}[a-z]*')) AS rest FROM d),
m AS (SELECT *, array_to_string(list_filter(rest[1:4], lambda t: length(t) > 1), ' ') AS j FROM c)
SELECT doc_id, n AS norm, CASE WHEN j <> '' THEN j WHEN len(rest) > 0 THEN array_to_string(rest, ' ') ELSE 'unknown' END AS merchant, {SIGNIFICANT.format('n')} AS token, {KEYWORD.format('n')} AS keyword, regexp_matches(n, '{REFUND}') AS refund FROM m"""


def f_mask(b):
    c = b.table("customer")
    mail, phone = F.concat("c_name", F.lit("@mail.example.org")), F.concat(F.lit("+91 "), (F.col("c_custkey") * 7919 + 1000000).cast("string"))
    return c.select("c_custkey", T.mask_account(F.col("c_name")).alias("account"), T.mask_email(mail).alias("email"), T.mask_phone(phone).alias("phone"), T.brand_of_domain(F.lit("Shop.example.com")).alias("brand"), T.identity_key(F.lit("BANK"), F.col("c_name")).alias("identity"))


F_MASK = """SELECT c_custkey, '****' || right(regexp_replace(c_name, '[^0-9]', '', 'g'), 4) AS account, left(c_name, 1) || '***@mail.example.org' AS email,
  '+*****' || right(CAST(c_custkey * 7919 + 1000000 AS VARCHAR), 3) AS phone, 'shop' AS brand, sha256('BANK:' || regexp_replace(c_name, '[^0-9]', '', 'g')) AS identity FROM customer"""


def f_similarity(b):
    p = b.table("part").select("p_name").distinct()
    x, y = p.select(F.col("p_name").alias("a")), p.select(F.col("p_name").alias("b"))
    pairs = x.join(y, F.substring("a", 1, 1) == F.substring("b", 1, 1))
    return pairs.select("a", "b", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


F_SIM = "WITH p AS (SELECT DISTINCT p_name AS n, string_split(p_name, ' ') AS t FROM part) SELECT x.n AS a, y.n AS b, round(1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n)), 6) AS similarity, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))), 6) AS jaccard FROM p x JOIN p y ON left(x.n, 1) = left(y.n, 1)"


def c1(b):
    return b.base.groupBy(T.keyword_category(_said()).alias("keyword"), "txn_type").agg(F.count("*").alias("rows"))


def _matches(b):
    return N.rule_matches(b.base, b.rules, ["txn_id", "user_id"])


def c3(b):
    return N.first_rule(_matches(b))


def c3_all(b):
    return _matches(b).select("txn_id", "rule_id", "action")


def c5(b):
    return N.side_effects(_matches(b))


def c4(b):
    rows = b.base.withColumn("merchant", F.when(F.col("tax") < 3, F.lit("click")).otherwise(F.col("merchant"))).withColumn("description", _said())
    return N.cascade(rows, b.rules, N.top_learnt(b.learning))


C4_SQL = f"""WITH {MATCHES.replace('FROM base b, rules r', f"FROM (SELECT * REPLACE (CASE WHEN tax < 3 THEN 'click' ELSE merchant END AS merchant, {SAID_SQL} AS description) FROM base) b, rules r")}, {WON}, {LEARN}, {TOP},
x0 AS (SELECT *, {NORM.format(SAID_SQL)} AS n FROM base), x AS (SELECT * REPLACE (CASE WHEN tax < 3 THEN 'click' ELSE merchant END AS merchant), {KEYWORD.format('n')} AS word FROM x0)
SELECT x.txn_id, coalesce(target, 'Category ' || category_id, word) AS suggested, CASE WHEN target IS NOT NULL THEN 'RULE' WHEN category_id IS NOT NULL THEN 'LEARNED_PATTERN' WHEN word <> 'Other' THEN 'KEYWORD_MATCH' ELSE 'DEFAULT' END AS decision
FROM x LEFT JOIN won ON won.txn_id = x.txn_id LEFT JOIN tl ON tl.user_id = x.user_id AND tl.merchant = x.merchant"""


def c2(b):
    """Every row against merchants that one row in ten has made, and the aliases that one in thirty has."""
    merchants = b.base.where("qty between 40 and 44").select("user_id", F.col("txn_id").alias("merchant_id"), F.col("description").alias("name"))
    aliases = b.base.where("qty = 50 and tax < 5").groupBy("user_id", T.normalize(F.col("description")).alias("alias")).agg(F.min("txn_id").alias("merchant_id"))
    return N.resolve_merchants(b.base, aliases, merchants)


C2_SQL = f"""WITH {V.BASE}, b2 AS (SELECT *, {NORM.format('description')} AS n FROM base), b3 AS (SELECT *, {SIGNIFICANT.format('n')} AS token FROM b2),
al AS (SELECT user_id, n, min(txn_id) AS by_alias FROM b3 WHERE qty = 50 AND tax < 5 GROUP BY 1, 2),
tk AS (SELECT user_id, token, min(txn_id) AS by_token FROM b3 WHERE qty BETWEEN 40 AND 44 AND token IS NOT NULL GROUP BY 1, 2)
SELECT txn_id, b3.user_id, coalesce(by_alias, by_token) AS merchant_id, CASE WHEN by_alias IS NOT NULL THEN 'ALIAS' WHEN by_token IS NOT NULL THEN 'TOKEN' ELSE 'NONE' END AS how
FROM b3 LEFT JOIN al ON al.user_id = b3.user_id AND al.n = b3.n LEFT JOIN tk ON tk.user_id = b3.user_id AND tk.token = b3.token"""


def c2_create(b):
    return N.create_merchants(b.base)


C2_CREATE = f"""WITH {V.BASE}, x AS (SELECT *, {NORM.format('description')} AS n FROM base), y AS (SELECT *, coalesce({SIGNIFICANT.format('n')}, '=' || n) AS key,
  array_to_string(list_transform(list_filter((list_filter(string_split(n, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '[a-z]*[0-9]{{4,}}[a-z]*')))[1:4], lambda t: length(t) > 1), lambda t: upper(t[1]) || t[2:]), ' ') AS name FROM x)
SELECT user_id, key, arg_min(name, (txn_date, txn_id)) AS name, count(DISTINCT n) AS aliases, count(*) AS rows FROM y GROUP BY 1, 2"""


def c6(b):
    kind = F.when(F.col("action") == "error", "UNDO").when((F.col("action") == "signup") & (F.col("k") < 10), "RESET").otherwise("CONFIRM")
    return N.replay(b.events.select("event_id", "ts", "user_id", F.lit("m").alias("merchant"), (F.col("k") % 5).cast("long").alias("category_id"), kind.alias("kind")))


C6_SQL = f"""WITH RECURSIVE {V.EVENTS}, o AS (SELECT user_id, CAST(k % 5 AS BIGINT) AS c, CASE WHEN action = 'error' THEN 'UNDO' WHEN action = 'signup' AND k < 10 THEN 'RESET' ELSE 'CONFIRM' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM ev),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS r, [0, 0, 0, 0, 0]::BIGINT[] AS n, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS learned, CAST(0 AS BIGINT) AS corrected FROM o
  UNION ALL SELECT f.user_id, o.r, CASE kind WHEN 'RESET' THEN [0, 0, 0, 0, 0]::BIGINT[] WHEN 'UNDO' THEN list_transform(n, lambda x, i: x - CASE WHEN i = last + 1 THEN 1 ELSE 0 END) ELSE list_transform(n, lambda x, i: x + CASE WHEN i = c + 1 THEN 1 ELSE 0 END) END,
    CASE WHEN kind = 'CONFIRM' THEN c END, learned + CASE WHEN kind = 'CONFIRM' AND (list_max(n) = 0 OR list_position(n, list_max(n)) = c + 1) THEN 1 ELSE 0 END,
    corrected + CASE WHEN kind = 'CONFIRM' AND list_max(n) > 0 AND list_position(n, list_max(n)) <> c + 1 THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1),
e AS (SELECT user_id, max_by(n, r) AS n, max_by(learned, r) AS learned, max_by(corrected, r) AS corrected FROM f GROUP BY 1),
x AS (SELECT user_id, unnest(n) AS m, generate_subscripts(n, 1) - 1 AS c, n, learned, corrected FROM e)
SELECT user_id, 'm' AS merchant, CAST(CASE WHEN m > 0 THEN c END AS BIGINT) AS category_id, m AS confirmations, learned, corrected FROM x WHERE m > 0 OR (list_max(n) = 0 AND c = 0)"""


def c8(b):
    merges = b.spark.createDataFrame([("click", "view"), ("signup", "view")], "merchant string, into string")
    return N.merge_merchants(b.learning, merges).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def c9(b):
    word = T.keyword_category(F.col("description"))
    return b.ledger.where((F.col("decision_source") == "MERCHANT_DEFAULT") & (word == "Other")).groupBy("user_id").agg(F.count("*").alias("ask"))


#: Facts of the events: eight events a section, most of them signals of the section's intended type, the others any signal.
C10_TYPES = ["SAVINGS", "CURRENT", "OVERDRAFT", "WALLET", "CREDIT_CARD", "RECURRING_DEPOSIT", "FIXED_DEPOSIT", "LOAN", "PPF", "EPF", "NPS", "DEMAT", "MUTUAL_FUND"]
C10_SIGNALS = ["DATE_COLUMN", "DESCRIPTION_COLUMN", "DEBIT_CREDIT_COLUMNS", "RUNNING_BALANCE_COLUMN", "TRANSACTION_ROWS", "OPENING_BALANCE_FIELD", "CLOSING_BALANCE_FIELD", "MATURITY_FIELD", "INTEREST_RATE_FIELD", "PRINCIPAL_FIELD", "INSTALLMENT_FIELD", "MINIMUM_DUE_FIELD", "TOTAL_DUE_FIELD", "CREDIT_LIMIT_FIELD", "CARD_NUMBER_FIELD", "EMI_FIELD", "OUTSTANDING_FIELD", "TENURE_FIELD"]
#: By type the places (from 1) in C10_SIGNALS of what is expected, forbidden and proving; and whether it must be named.
C10_ROWS = [
    ([1, 2, 3, 4, 5, 6, 7], [8, 11, 16, 12, 13], [1, 2, 5, 6, 7], False), ([1, 2, 3, 4, 5], [8, 11, 16, 12], [1, 2, 5], True), ([1, 2, 4, 5, 14], [8, 11, 12], [1, 5], True), ([1, 2, 5, 4], [8, 11, 16, 14], [1, 5], True),
    ([12, 13, 14, 15, 1, 2], [8, 11, 6], [15, 13], False), ([11, 8, 1, 9], [2, 12, 16], [11, 8], False), ([8, 9, 10, 1], [2, 11, 12, 16], [10, 9, 8], False), ([16, 17, 18, 9], [12, 15], [17, 16], False),
    ([], [2, 12], [], True), ([], [2, 12], [], True), ([], [2, 12], [], True), ([], [2, 12], [], True), ([], [2, 12], [], True),
]


def _strings(values):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def c10(b):
    e = b.events
    doc = F.floor(F.col("event_id") / 8)
    kind = (doc % 13).cast("int")
    expected = F.get(F.array(*[_strings([C10_SIGNALS[k - 1] for k in row[0]]) for row in C10_ROWS]), kind)
    own = F.get(expected, (F.col("event_id") % F.greatest(F.size(expected), F.lit(1))).cast("int"))
    # one event in eight names the type, or the next one; some are noise
    naming = F.col("event_id") % 8 == 7
    noise = F.get(_strings(C10_SIGNALS), F.col("k") % 18)
    signal = F.when(naming, "PRODUCT_NAME").when((F.col("k") % 9 == 0) | own.isNull(), noise).otherwise(own)
    place = F.get(_strings(list(P.PLACES)), F.when(F.col("k") % 7 == 0, 3).otherwise(F.col("k") % 3).cast("int"))
    named = F.when(naming, F.get(_strings(C10_TYPES), ((kind + (F.col("k") % 10 == 1).cast("int")) % 13).cast("int")))
    return P.classify(e.select(doc.alias("doc_id"), place.alias("place"), signal.alias("signal"), named.alias("named")))


_C10_TABLE = ", ".join(f"({n}, '{t}', CAST({e} AS INT[]), CAST({f} AS INT[]), CAST({p} AS INT[]), {str(must).lower()})" for n, (t, (e, f, p, must)) in enumerate(zip(C10_TYPES, C10_ROWS, strict=True)))
C10_SQL = f"""WITH {V.EVENTS}, h(n, type, expected, forbidden, proof, must) AS (VALUES {_C10_TABLE}),
x AS (SELECT event_id, k, event_id // 8 AS doc_id, event_id % 8 = 7 AS naming, h.n, h.expected FROM ev JOIN h ON h.n = event_id // 8 % 13),
f AS (SELECT doc_id, CASE WHEN k % 7 = 0 THEN 3 ELSE k % 3 END AS place, CASE WHEN naming THEN NULL WHEN k % 9 = 0 OR len(expected) = 0 THEN k % 18 + 1 ELSE expected[event_id % len(expected) + 1] END AS signal, CASE WHEN naming THEN (n + CASE WHEN k % 10 = 1 THEN 1 ELSE 0 END) % 13 END AS named FROM x),
s AS (SELECT doc_id, signal, min(place) AS place FROM f WHERE signal IS NOT NULL GROUP BY 1, 2),
m AS (SELECT doc_id, named, min(place) AS place FROM f WHERE named IS NOT NULL GROUP BY 1, 2),
d AS (SELECT DISTINCT doc_id FROM f),
w(place, weight) AS (VALUES (0, 1.0), (1, 0.8), (2, 0.6), (3, 0.15)),
e AS (SELECT d.doc_id, h.n, count(s.signal) AS support, coalesce(sum(w.weight), 0) AS earned FROM d CROSS JOIN h LEFT JOIN s ON s.doc_id = d.doc_id AND list_contains(h.expected, s.signal) LEFT JOIN w ON w.place = s.place GROUP BY 1, 2),
c AS (SELECT d.doc_id, h.n, count(s.signal) AS against FROM d CROSS JOIN h LEFT JOIN s ON s.doc_id = d.doc_id AND s.place < 3 AND list_contains(h.forbidden, s.signal) GROUP BY 1, 2),
p AS (SELECT d.doc_id, h.n, len(h.proof) > 0 AND count(s.signal) = len(h.proof) AS proved FROM d CROSS JOIN h LEFT JOIN s ON s.doc_id = d.doc_id AND list_contains(h.proof, s.signal) GROUP BY d.doc_id, h.n, h.proof),
g AS (SELECT e.doc_id, h.n, h.type, p.proved, CASE WHEN against > 0 OR (must AND NOT coalesce(m.place < 3, false)) THEN 0 WHEN len(expected) = 0 THEN CAST(nw.weight AS DOUBLE) WHEN support + CASE WHEN coalesce(m.place < 3, false) THEN 1 ELSE 0 END < 2 THEN 0
    ELSE least(0.95, round(CAST(earned + coalesce(nw.weight, 0) AS DOUBLE) / CAST(len(expected) + coalesce(nw.weight, 0) AS DOUBLE), 9)) END AS score
  FROM e JOIN h ON h.n = e.n JOIN c ON c.doc_id = e.doc_id AND c.n = e.n JOIN p ON p.doc_id = e.doc_id AND p.n = e.n LEFT JOIN m ON m.doc_id = e.doc_id AND m.named = e.n LEFT JOIN w nw ON nw.place = m.place),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS r FROM g)
SELECT doc_id, CASE WHEN least(score, 0.95) >= 0.6 THEN type ELSE 'UNKNOWN' END AS product, round(least(score, 0.95), 6) AS score, CASE WHEN least(score, 0.95) < 0.6 THEN 'UNIDENTIFIED' WHEN proved THEN 'VALIDATED' ELSE 'UNPROVEN' END AS verdict FROM b WHERE r = 1"""


def c11(b):
    found = b.table("customer").select(F.col("c_custkey").alias("found_id"), F.concat(F.lit("B"), F.col("c_nationkey") % 3).alias("institution"), (F.col("c_custkey") * 31 + 5000).cast("string").alias("number"))
    known = b.table("customer").select(F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("B"), F.col("c_nationkey") % 3)).otherwise("OTHER").alias("institution"), F.when(F.col("c_custkey") % 8 == 0, (F.col("c_custkey") * 31 + 5000).cast("string")).otherwise(F.concat(F.lit("99"), (F.col("c_custkey") * 31 + 5000).cast("string"))).alias("number"))
    return N.match_products(found, known)


C11_SQL = """WITH f AS (SELECT c_custkey AS found_id, 'B' || c_nationkey % 3 AS i, CAST(c_custkey * 31 + 5000 AS VARCHAR) AS n FROM customer),
k AS (SELECT CASE WHEN found_id % 4 = 0 THEN i ELSE 'OTHER' END AS i, CASE WHEN found_id % 8 = 0 THEN n ELSE '99' || n END AS n FROM f)
SELECT found_id, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.i = f.i AND k.n = f.n) THEN 'EXACT' WHEN EXISTS (SELECT 1 FROM k WHERE k.i = f.i AND right(k.n, 4) = right(f.n, 4)) THEN 'PROBABLE' ELSE 'NONE' END AS match FROM f"""


def c12(b):
    return N.explain(b.ledger.select("txn_id", "decision_source"), c3(b), b.rules)


C12_SQL = f"""WITH {V.LEDGER}, {V.RULES_SQL}, mt AS (SELECT * FROM (SELECT b.*, r.*, CASE field WHEN 'DESCRIPTION' THEN description WHEN 'MERCHANT' THEN merchant ELSE CAST(amount AS VARCHAR) END AS f FROM base b, rules r WHERE rule_user IS NULL OR rule_user = user_id) WHERE coalesce({HOLDS}, false)), {WON}
SELECT l.txn_id, CASE WHEN decision_source IN ('GLOBAL_RULE', 'USER_RULE') THEN CASE WHEN w.rule_id IS NULL THEN 'The rule is no longer available' ELSE concat_ws(' ', lower(field), lower(operator), value, '→', w.target) END
  WHEN decision_source = 'LEARNED_PATTERN' THEN 'Learnt from earlier choices' WHEN decision_source = 'KEYWORD_MATCH' THEN 'A keyword of the description' WHEN decision_source = 'MANUAL' THEN 'Set by hand' WHEN decision_source = 'FILE_PROVIDED' THEN 'Given in the file' ELSE 'The merchant''s default' END AS explanation
FROM ledger l LEFT JOIN won w ON w.txn_id = l.txn_id LEFT JOIN rules r ON r.rule_id = w.rule_id"""


def a14(b):
    return N.category_confidence(N.top_learnt(b.learning))


def a16(b):
    month = F.date_format(F.col("ts") + F.expr("interval 330 minutes"), "yyyy-MM")
    return b.events.groupBy(month.alias("month")).agg(F.count(F.when(F.col("action") == "click", 1)).alias("learned"), F.count(F.when(F.col("action") == "view", 1)).alias("corrected"))


def a31(b):
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(a)
    return b.events.groupBy("user_id").agg(n("click"), n("view"), n("error"), n("signup"))


def a32(b):
    return N.confidences(b.learning)


def w6(b):
    return N.top_learnt(b.learning)


def j11(b):
    ids = b.base.where("qty = 50").select("user_id", F.lower(F.element_at(F.split("description", " "), -1)).alias("identifier")).distinct()
    # a row's text is normalised once, not for each identifier that it meets
    rows = b.base.select("txn_id", "user_id", T.normalize(F.col("description")).alias("norm"))
    return rows.join(ids, "user_id").where(F.contains("norm", "identifier")).select("txn_id").distinct()


def j17(b):
    """A file for each customer: its name and five lines name institutions (after nations) in words, split words and codes, alone or against each other."""
    nation = b.table("nation").select(F.col("n_nationkey").cast("int").alias("n"), "n_name")
    aliases = nation.select("n_name", F.explode(F.array(F.concat(F.lit("Bank of "), "n_name"), F.concat(F.left("n_name", F.lit(3)), F.lit(" Bank")), F.concat("n_name", F.lit(" Savings Bank")))).alias("alias"))
    codes = nation.select("n_name", F.left(F.concat(F.regexp_replace("n_name", " ", ""), F.lit("XXXX")), F.lit(4)).alias("prefix"))
    c = b.table("customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").cast("int").alias("n"), F.col("c_custkey").alias("key"))
    # the institution that each line is about: the customer's own nation or one of the next
    about = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.col("n") + F.when((F.col("key") % (k + 3)) == 0, k).otherwise(0)) % 25).cast("int"))).alias("at", "m")
    said = c.select("file", "key", about).join(F.broadcast(nation.withColumnRenamed("n", "m")), "m")
    code = F.concat(F.left(F.concat(F.regexp_replace("n_name", " ", ""), F.lit("XXXX")), F.lit(4)), F.lit("0"), F.lpad((F.col("key") % 1000000).cast("string"), 6, "0"))
    at, key = F.col("at"), F.col("key")
    text = (
        F.when((at == 0) & (key % 5 == 0), F.concat(F.lit("IFSC : "), code)).when((at == 1) & (key % 5 == 1), F.concat(F.lit("IFSC code "), code, F.lit(" branch")))
        .when((at == 2) & (key % 4 != 3), F.concat(F.lit("Welcome to bank  of-"), F.lower("n_name"))).when((at == 3) & (key % 3 != 1), F.concat(F.initcap(F.left("n_name", F.lit(3))), F.lit("bank, your "), F.lower("n_name"), F.lit(" savings bank")))
        .when((at == 4) & (key % 7 == 2), F.concat(F.lit("paid to "), code)).when((at == 5) & (key % 2 == 0), F.concat(F.lower("n_name"), F.lit("bankofx xbank of "), F.lower("n_name")))
    )
    lines = said.select("file", text.alias("text")).where("text is not null")
    files = c.join(F.broadcast(nation), "n").select("file", F.concat(F.lit("stmt_"), F.left(F.lower("n_name"), F.lit(3)), F.when(key % 6 == 0, F.lit("x")).otherwise(F.lit("_")), F.lit("bank_2024.pdf")).alias("name"))
    return institutions.detect(files, lines, aliases.withColumnRenamed("n_name", "institution"), codes.withColumnRenamed("n_name", "institution"))


#: An alias as a pattern: its letters with anything but letters and digits between them, neither in front nor behind.
J17_SQL = r"""WITH nat AS (SELECT CAST(n_nationkey AS INT) AS n, n_name, substr(replace(n_name, ' ', '') || 'XXXX', 1, 4) AS prefix FROM nation),
al AS (SELECT n_name, upper(regexp_replace(a, '[^A-Za-z0-9]', '', 'g')) AS a FROM (SELECT n_name, unnest(['Bank of ' || n_name, left(n_name, 3) || ' Bank', n_name || ' Savings Bank']) AS a FROM nat)),
pat AS (SELECT n_name, strlen(a) AS len, '(^|[^A-Z0-9])' || array_to_string(string_split(a, ''), '[^A-Z0-9]*') || '([^A-Z0-9]|$)' AS p FROM al),
c AS (SELECT c_custkey AS file, c_custkey AS key, CAST(c_nationkey AS INT) AS n, unnest(range(6)) AS pos FROM customer),
s AS (SELECT file, key, pos, n_name, prefix || '0' || lpad(CAST(key % 1000000 AS VARCHAR), 6, '0') AS code FROM c JOIN nat ON nat.n = (c.n + CASE WHEN key % (pos + 3) = 0 THEN pos ELSE 0 END) % 25),
t AS (SELECT DISTINCT file, CASE WHEN pos = 0 AND key % 5 = 0 THEN 'IFSC : ' || code WHEN pos = 1 AND key % 5 = 1 THEN 'IFSC code ' || code || ' branch' WHEN pos = 2 AND key % 4 <> 3 THEN 'Welcome to bank  of-' || lower(n_name)
    WHEN pos = 3 AND key % 3 <> 1 THEN upper(left(n_name, 1)) || lower(substr(n_name, 2, 2)) || 'bank, your ' || lower(n_name) || ' savings bank' WHEN pos = 4 AND key % 7 = 2 THEN 'paid to ' || code WHEN pos = 5 AND key % 2 = 0 THEN lower(n_name) || 'bankofx xbank of ' || lower(n_name) END AS text FROM s),
l AS (SELECT * FROM t WHERE text IS NOT NULL),
k AS (SELECT file, upper(text) LIKE '%IFSC%' AS labelled, n_name FROM (SELECT file, text, unnest(regexp_extract_all(text, '([A-Z]{4})0[A-Z0-9]{6}', 1)) AS code FROM l) x JOIN nat ON nat.prefix = x.code),
bk AS (SELECT file, CASE WHEN count(DISTINCT n_name) FILTER (labelled) = 1 THEN min(n_name) FILTER (labelled) END AS by_label, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) END AS by_code FROM k GROUP BY 1),
words AS (SELECT DISTINCT text FROM l), hit AS (SELECT w.text, pat.n_name, pat.len, max(pat.len) OVER (PARTITION BY w.text) AS longest FROM words w JOIN pat ON regexp_matches(upper(w.text), pat.p)),
v AS (SELECT l.file, hit.n_name, count(DISTINCT l.text) AS lines FROM l JOIN hit ON hit.text = l.text AND hit.len = hit.longest GROUP BY 1, 2),
bt AS (SELECT file, CASE WHEN count(*) = 1 THEN min(n_name) END AS by_text FROM (SELECT *, max(lines) OVER (PARTITION BY file) AS most FROM v) WHERE lines = most GROUP BY 1),
names AS (SELECT DISTINCT key % 6 = 0 AS welded, nat.n_name, 'STMT_' || left(nat.n_name, 3) || CASE WHEN key % 6 = 0 THEN 'X' ELSE '_' END || 'BANK_2024.PDF' AS name FROM c JOIN nat ON nat.n = c.n),
nh AS (SELECT names.name, pat.n_name, pat.len, max(pat.len) OVER (PARTITION BY names.name) AS longest FROM (SELECT DISTINCT name FROM names) names JOIN pat ON regexp_matches(names.name, pat.p)),
bn AS (SELECT name, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) END AS by_name FROM nh WHERE len = longest GROUP BY 1),
f AS (SELECT DISTINCT c.file, 'STMT_' || left(nat.n_name, 3) || CASE WHEN key % 6 = 0 THEN 'X' ELSE '_' END || 'BANK_2024.PDF' AS name FROM c JOIN nat ON nat.n = c.n)
SELECT f.file, coalesce(by_label, by_text, by_code, by_name, 'OTHER') AS institution, CASE WHEN by_label IS NOT NULL THEN 'LABELLED_CODE' WHEN by_text IS NOT NULL THEN 'TEXT' WHEN by_code IS NOT NULL THEN 'CODE' WHEN by_name IS NOT NULL THEN 'FILE_NAME' ELSE 'NONE' END AS signal
FROM f LEFT JOIN bk ON bk.file = f.file LEFT JOIN bt ON bt.file = f.file LEFT JOIN bn ON bn.name = f.name"""
QUERIES = {
    "F_text_functions": (f_text, F_TEXT),
    "F_masking_and_identity": (f_mask, F_MASK),
    "F_similarity": (f_similarity, F_SIM),
    "C1_keyword_category": (c1, f"WITH {V.BASE}, x AS (SELECT *, {NORM.format(SAID_SQL)} AS n FROM base) SELECT {KEYWORD.format('n')} AS keyword, txn_type, count(*) AS rows FROM x GROUP BY 1, 2"),
    "C2_merchant_resolution": (c2, C2_SQL),
    "C2_merchant_creation": (c2_create, C2_CREATE),
    "C3_first_rule": (c3, f"WITH {MATCHES}, {WON} SELECT txn_id, rule_id, target FROM won"),
    "C3_P10_all_matches": (c3_all, f"WITH {MATCHES} SELECT txn_id, rule_id, action FROM mt"),
    "C4_suggestion_cascade": (c4, C4_SQL),
    "C5_side_effects": (c5, f"WITH {MATCHES} SELECT txn_id, bool_or(action = 'MARK_TRANSFER') AS mark_transfer, bool_or(action = 'MARK_SUBSCRIPTION') AS mark_subscription, arg_max(CASE WHEN target = '' THEN 'Investments' ELSE target END, (CASE WHEN scope = 'USER' THEN 0 ELSE 1 END, priority, rule_id)) FILTER (action = 'MARK_INVESTMENT') AS investment, coalesce(array_to_string(list_sort(list(DISTINCT target) FILTER (action = 'ADD_TAG')), ','), '') AS tags FROM mt WHERE action <> 'ASSIGN_CATEGORY' GROUP BY 1"),
    "C6_C7_learning_replay": (c6, C6_SQL),
    "C8_merchant_merge": (c8, f"WITH {LEARN}, m AS (SELECT user_id, CASE WHEN merchant IN ('click', 'signup') THEN 'view' ELSE merchant END AS merchant, category_id, sum(confirmations) AS confirmations, max(last_at) AS last_at FROM learning GROUP BY 1, 2, 3) SELECT user_id, merchant, category_id, CAST(confirmations AS BIGINT) AS confirmations, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, CAST(floor(confirmations * 100 / sum(confirmations) OVER (PARTITION BY user_id, merchant) + 0.5) AS BIGINT) AS confidence FROM m"),
    "C9_ask_once": (c9, f"WITH {V.LEDGER} SELECT user_id, count(*) AS ask FROM ledger WHERE decision_source = 'MERCHANT_DEFAULT' AND {KEYWORD.format(NORM.format('description'))} = 'Other' GROUP BY 1"),
    "C10_product_classifier": (c10, C10_SQL),
    "C11_product_identity": (c11, C11_SQL),
    "C12_explanations": (c12, C12_SQL),
    "A14_category_confidence": (a14, f"WITH {LEARN}, {TOP} SELECT category_id, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS confidence, count(*) AS merchants FROM tl GROUP BY 1"),
    "A16_learning_growth": (a16, f"WITH {V.EVENTS} SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') AS month, count(*) FILTER (action = 'click') AS learned, count(*) FILTER (action = 'view') AS corrected FROM ev GROUP BY 1"),
    "A31_learning_summary": (a31, f"WITH {V.EVENTS} SELECT user_id, " + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("click", "view", "error", "signup")) + " FROM ev GROUP BY 1"),
    "A32_confidence_distribution": (a32, f"WITH {LEARN} SELECT user_id, merchant, category_id, CAST(floor(confirmations * 100 / sum(confirmations) OVER (PARTITION BY user_id, merchant) + 0.5) AS BIGINT) AS confidence FROM learning"),
    "W6_top_learnt": (w6, f"WITH {LEARN}, {TOP} SELECT user_id, merchant, category_id, confirmations, confidence FROM tl"),
    "J11_identifier_join": (j11, f"WITH {V.BASE}, i AS (SELECT DISTINCT user_id, lower(string_split(description, ' ')[-1]) AS identifier FROM base WHERE qty = 50) SELECT DISTINCT txn_id FROM base b JOIN i ON b.user_id = i.user_id AND contains({NORM.format('description')}, identifier)"),
    "J17_institution": (j17, J17_SQL),
}
