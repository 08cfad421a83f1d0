"""The ledger model over the star-schema tables.

Each view is a plain projection of Parquet tables, so filters and columns are pushed
to the scans. Reference dates are parameters everywhere; nothing reads a clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2000-12-31"
EVENTS_AS_OF = "2024-01-31"
DECISIONS = ["GLOBAL_RULE", "USER_RULE", "LEARNED_PATTERN", "KEYWORD_MATCH", "MERCHANT_DEFAULT", "MANUAL", "FILE_PROVIDED"]
SOURCES = ["MANUAL", "CSV_IMPORT", "GMAIL_IMPORT"]
#: (rule_id, scope, user_id, field, operator, value, category, action, priority)
RULES = [
    (1, "GLOBAL", None, "DESCRIPTION", "CONTAINS", "widget", "Gadgets", "ASSIGN_CATEGORY", 100),
    (2, "GLOBAL", None, "DESCRIPTION", "STARTS_WITH", "card payment red", "Red cards", "ASSIGN_CATEGORY", 50),
    (3, "USER", 7, "MERCHANT", "EQUALS", "brand#7", "Favourite", "ASSIGN_CATEGORY", 10),
    (4, "USER", 7, "AMOUNT", "GREATER_THAN", "1500", "Large", "ASSIGN_CATEGORY", 20),
    (5, "GLOBAL", None, "AMOUNT", "BETWEEN", "1000,1010", "Thousand", "ASSIGN_CATEGORY", 70),
    (6, "GLOBAL", None, "AMOUNT", "LESS_THAN", "905", "Small", "ASSIGN_CATEGORY", 80),
    (7, "GLOBAL", None, "DESCRIPTION", "CONTAINS", "gear", "tools", "ADD_TAG", 100),
    (8, "GLOBAL", None, "MERCHANT", "EQUALS", "BRAND#3", "", "MARK_TRANSFER", 100),
    (9, "GLOBAL", None, "AMOUNT", "GREATER_THAN", "abc", "Never", "ASSIGN_CATEGORY", 1),
    (10, "GLOBAL", None, "DESCRIPTION", "STARTS_WITH", "refund", "", "MARK_INVESTMENT", 60),
    (11, "USER", 7, "AMOUNT", "LESS_THAN", "1200", "Funds", "MARK_INVESTMENT", 5),
    (12, "GLOBAL", None, "MERCHANT", "EQUALS", "brand#5", "", "MARK_SUBSCRIPTION", 100),
]
RULE_SCHEMA = "rule_id int, scope string, rule_user long, field string, operator string, value string, target string, action string, priority int"


class Book:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        """Ledger rows before reconciliation."""
        item, part = self.table("lineitem"), self.table("part")
        kind = F.when(F.col("l_returnflag") == "R", "INCOME").otherwise("EXPENSE")
        name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Refund - "), "p_name")).when(F.col("l_linestatus") == "F", F.concat(F.lit("Card Payment "), "p_name")).otherwise(F.col("p_name"))
        return item.join(part, item["l_partkey"] == part["p_partkey"]).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("txn_id"),
            F.col("l_suppkey").alias("user_id"),
            (F.col("l_suppkey") * 10 + F.col("l_linenumber") % 3).alias("account_id"),
            F.to_date("l_shipdate").alias("txn_date"),
            F.date_format("l_shipdate", "yyyy-MM").alias("ym"),
            F.col("p_brand").alias("merchant"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(14,2)").alias("amount"),
            kind.alias("txn_type"),
            name.alias("description"),
            F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
            F.col("l_quantity").cast("int").alias("qty"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Ledger rows with the marks of a finished reconciliation."""
        # an account is one user's, so rows dealt by user serve both windows: one shuffle of whole rows
        first = F.min("txn_id").over(Window.partitionBy("user_id", "account_id"))
        bought = F.min(F.when(F.col("txn_type") == "EXPENSE", F.col("txn_id"))).over(Window.partitionBy("user_id", "merchant"))
        rows = self.base.repartition("user_id").withColumn("first_id", first).withColumn("bought_id", bought)
        duplicate = F.when((F.col("tax") == 8) & (F.col("qty") <= 5) & (F.col("first_id") != F.col("txn_id")), F.col("first_id"))
        rows = rows.withColumn("duplicate_of", duplicate).withColumn("is_transfer", (F.col("tax") == 7) & (F.col("qty") > 40) & F.col("duplicate_of").isNull())
        refund = F.when((F.col("txn_type") == "INCOME") & (F.col("qty") >= 30) & ~F.col("is_transfer") & F.col("duplicate_of").isNull(), F.col("bought_id"))
        rows = rows.withColumn("refund_of", refund)
        status = F.when(F.col("duplicate_of").isNotNull(), "DUPLICATE").when(F.col("is_transfer"), "TRANSFER").when(F.col("refund_of").isNotNull(), "REFUND").otherwise("OK")
        return rows.select(
            "txn_id", "user_id", "account_id", "txn_date", "ym", "merchant", "category", "amount", "txn_type", "description", "duplicate_of", "is_transfer", "refund_of", status.alias("status"),
            F.element_at(F.array(*map(F.lit, DECISIONS)), F.col("tax") % 7 + 1).alias("decision_source"),
            F.element_at(F.array(*map(F.lit, SOURCES)), F.col("tax") % 3 + 1).alias("source"),
            ((F.col("tax") == 0) & (F.col("qty") <= 3)).alias("needs_review"),
            ((F.col("tax") == 3) & (F.col("qty") <= 10)).alias("is_recurring"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """Audit events: action, local value k and the time."""
        return self.table("events").select("event_id", "ts", "user_id", F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "props")

    @cached_property
    def ledger_events(self) -> DataFrame:
        kind = F.when(F.col("event_type").isin("signup", "error"), "INCOME").otherwise("EXPENSE")
        return self.table("events").select(
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("txn_id"), "user_id", F.col("user_id").alias("account_id"), F.to_date("ts").alias("txn_date"), F.col("ts").alias("created_at"),
            F.col("event_type").alias("merchant"), F.col("event_type").alias("description"), F.floor("value").cast("decimal(14,2)").alias("amount"), kind.alias("txn_type"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        supplier, customer = self.table("supplier"), self.table("customer")
        users = supplier.agg(F.count("*").alias("users"))
        own = supplier.select(F.col("s_suppkey").alias("account_key"), F.col("s_suppkey").alias("user_id"), F.lit("SAVINGS").alias("account_type"), F.col("s_acctbal").cast("decimal(14,2)").alias("balance"), F.lit(None).cast("decimal(14,2)").alias("credit_limit"))
        card = F.col("c_mktsegment") == "MACHINERY"
        kind = F.when(card, "CREDIT_CARD").when(F.col("c_mktsegment") == "BUILDING", "WALLET").when(F.col("c_mktsegment") == "HOUSEHOLD", "SAVINGS").otherwise("INVESTMENT")
        balance = F.col("c_acctbal").cast("decimal(14,2)")
        other = customer.join(F.broadcast(users)).select(
            (F.col("c_custkey") + 1_000_000_000).alias("account_key"), (F.col("c_custkey") % F.col("users")).alias("user_id"), kind.alias("account_type"),
            F.when(card, F.greatest(balance, F.lit(0).cast("decimal(14,2)"))).otherwise(balance).alias("balance"), F.when(card, F.lit(10000)).cast("decimal(14,2)").alias("credit_limit"),
        )
        return own.unionByName(other)

    @cached_property
    def budgets(self) -> DataFrame:
        """One limit for each user and category in use."""
        limit = (1000 + (F.col("user_id") % 7) * 500).cast("decimal(14,2)")
        return self.base.select("user_id", "category").distinct().where(F.col("user_id") % 3 != 0).withColumn("limit_amount", limit)

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(RULES, RULE_SCHEMA)

    @cached_property
    def learning(self) -> DataFrame:
        """Confirmations of a category for a user's merchant: counts and the last time."""
        pairs = self.events.groupBy("user_id", F.col("action").alias("merchant"), (F.col("k") % 5).alias("category_id"))
        return pairs.agg(F.count("*").alias("confirmations"), F.max("ts").alias("last_at"))

    @cached_property
    def imports(self) -> DataFrame:
        """Statement imports: a layout fingerprint, its rows and when."""
        return self.table("documents").select(F.col("doc_id").alias("import_id"), F.concat("source", "lang").alias("fingerprint"), F.col("n_chars").alias("rows"), F.col("lang").alias("bank"), (F.col("doc_id") * 37 % 1000).alias("duration"), (F.col("doc_id") % 400).cast("int").alias("day"))


# The same views for DuckDB.
_DECISIONS = "[" + ", ".join(f"'{x}'" for x in DECISIONS) + "]"
_SOURCES = "[" + ", ".join(f"'{x}'" for x in SOURCES) + "]"
BASE = """base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS txn_id, l_suppkey AS user_id, l_suppkey * 10 + l_linenumber % 3 AS account_id,
    CAST(l_shipdate AS DATE) AS txn_date, strftime(l_shipdate, '%Y-%m') AS ym, p_brand AS merchant, p_type AS category, CAST(p_retailprice AS DECIMAL(14,2)) AS amount,
    CASE WHEN l_returnflag = 'R' THEN 'INCOME' ELSE 'EXPENSE' END AS txn_type,
    CASE WHEN l_returnflag = 'R' THEN 'Refund - ' || p_name WHEN l_linestatus = 'F' THEN 'Card Payment ' || p_name ELSE p_name END AS description,
    CAST(round(l_tax * 100) AS INT) AS tax, CAST(l_quantity AS INT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LEDGER = (
    BASE
    + f""", marked AS (
  SELECT *, min(txn_id) OVER (PARTITION BY account_id) AS first_id, min(CASE WHEN txn_type = 'EXPENSE' THEN txn_id END) OVER (PARTITION BY user_id, merchant) AS bought_id FROM base),
dup AS (SELECT *, CASE WHEN tax = 8 AND qty <= 5 AND first_id <> txn_id THEN first_id END AS duplicate_of FROM marked),
trf AS (SELECT *, tax = 7 AND qty > 40 AND duplicate_of IS NULL AS is_transfer FROM dup),
ref AS (SELECT *, CASE WHEN txn_type = 'INCOME' AND qty >= 30 AND NOT is_transfer AND duplicate_of IS NULL THEN bought_id END AS refund_of FROM trf),
ledger AS (
  SELECT *, CASE WHEN duplicate_of IS NOT NULL THEN 'DUPLICATE' WHEN is_transfer THEN 'TRANSFER' WHEN refund_of IS NOT NULL THEN 'REFUND' ELSE 'OK' END AS status,
    {_DECISIONS}[tax % 7 + 1] AS decision_source, {_SOURCES}[tax % 3 + 1] AS source, tax = 0 AND qty <= 3 AS needs_review, tax = 3 AND qty <= 10 AS is_recurring
  FROM ref)"""
)
EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type AS action, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, props FROM events)"
LEDGER_EVENTS = "le AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS txn_id, user_id, user_id AS account_id, CAST(ts AS DATE) AS txn_date, ts AS created_at, event_type AS merchant, event_type AS description, CAST(floor(value) AS DECIMAL(14,2)) AS amount, CASE WHEN event_type IN ('signup', 'error') THEN 'INCOME' ELSE 'EXPENSE' END AS txn_type FROM events)"
ACCOUNTS = """accounts AS (
  SELECT s_suppkey AS account_key, s_suppkey AS user_id, 'SAVINGS' AS account_type, CAST(s_acctbal AS DECIMAL(14,2)) AS balance, CAST(NULL AS DECIMAL(14,2)) AS credit_limit FROM supplier
  UNION ALL
  SELECT c_custkey + 1000000000, c_custkey % (SELECT count(*) FROM supplier),
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'CREDIT_CARD' WHEN 'BUILDING' THEN 'WALLET' WHEN 'HOUSEHOLD' THEN 'SAVINGS' ELSE 'INVESTMENT' END,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN greatest(CAST(c_acctbal AS DECIMAL(14,2)), CAST(0 AS DECIMAL(14,2))) ELSE CAST(c_acctbal AS DECIMAL(14,2)) END,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(10000 AS DECIMAL(14,2)) END FROM customer)"""
BUDGETS = "budgets AS (SELECT DISTINCT user_id, category, CAST(1000 + (user_id % 7) * 500 AS DECIMAL(14,2)) AS limit_amount FROM base WHERE user_id % 3 <> 0)"
LEARNING = "learning AS (SELECT user_id, action AS merchant, k % 5 AS category_id, count(*) AS confirmations, max(ts) AS last_at FROM ev GROUP BY ALL)"
IMPORTS = "imports AS (SELECT doc_id AS import_id, source || lang AS fingerprint, n_chars AS rows, lang AS bank, doc_id * 37 % 1000 AS duration, CAST(doc_id % 400 AS INT) AS day FROM documents)"
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in RULES) + ") t(rule_id, scope, rule_user, field, operator, value, target, action, priority))"
