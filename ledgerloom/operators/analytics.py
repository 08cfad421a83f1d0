"""Refund netting, dashboards, reports, budgets, health and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money


def reportable(ledger: DataFrame) -> DataFrame:
    """Rows that are no duplicate, no transfer and no refund leg."""
    return ledger.where("duplicate_of is null and not is_transfer and status != 'REFUND'")


def refund_offsets(ledger: DataFrame) -> DataFrame:
    """What was refunded of each purchase, over all time."""
    return ledger.where("status = 'REFUND' and refund_of is not null").groupBy(F.col("refund_of").alias("purchase_id")).agg(F.sum("amount").alias("refunded"))


def netted(ledger: DataFrame) -> DataFrame:
    """Reportable rows with ``net``: an expense less its refunds, not below 0; income as it is."""
    rows = reportable(ledger)
    joined = rows.join(refund_offsets(ledger), rows["txn_id"] == F.col("purchase_id"), "left")
    amount = F.coalesce("amount", F.lit(0).cast("decimal(14,2)"))
    rest = F.greatest(F.lit(0).cast("decimal(24,2)"), amount - F.coalesce("refunded", F.lit(0).cast("decimal(24,2)")))
    return joined.withColumn("net", F.when(F.col("txn_type") == "EXPENSE", rest).otherwise(amount).cast("decimal(14,2)")).drop("purchase_id", "refunded")


def by_type(kind: str, value: str = "net") -> Column:
    return F.sum(F.when(F.col("txn_type") == kind, F.col(value)).otherwise(F.lit(0).cast("decimal(14,2)")))


def monthly(ledger: DataFrame) -> DataFrame:
    """Income and expense of each user and month."""
    return netted(ledger).groupBy("user_id", "ym").agg(by_type("INCOME").alias("income"), by_type("EXPENSE").alias("expense"), F.count("*").alias("rows"))


def reporting_period(months: DataFrame, as_of_month: str) -> DataFrame:
    """The newest month with data, whether it is the calendar month, and the month before it."""
    newest = months.where(F.col("ym") <= as_of_month).groupBy("user_id").agg(F.max("ym").alias("ym"))
    prior = F.date_format(F.add_months(F.to_date(F.concat("ym", F.lit("-01"))), -1), "yyyy-MM")
    return newest.select("user_id", "ym", (F.col("ym") == as_of_month).alias("is_current"), prior.alias("prior_ym"))


def dashboard(ledger: DataFrame, as_of_month: str) -> DataFrame:
    """Reporting month and prior month with changes in percent and the savings rate."""
    months = monthly(ledger)
    period = reporting_period(months, as_of_month)
    both = period.alias("p").join(months.alias("m"), (F.col("p.user_id") == F.col("m.user_id")) & F.col("m.ym").isin(F.col("p.ym"), F.col("p.prior_ym")))
    pick = lambda c, ym: F.sum(F.when(F.col("m.ym") == F.col(f"p.{ym}"), F.col(f"m.{c}")).otherwise(F.lit(0).cast("decimal(14,2)"))).alias
    sums = both.groupBy(F.col("p.user_id").alias("user_id"), F.col("p.ym").alias("ym"), F.col("p.prior_ym").alias("prior_ym"), "is_current").agg(pick("income", "ym")("income"), pick("expense", "ym")("expense"), pick("income", "prior_ym")("prior_income"), pick("expense", "prior_ym")("prior_expense"))
    return sums.select("user_id", "ym", "prior_ym", "is_current", "income", "expense", "prior_income", "prior_expense", change("income", "prior_income").alias("income_change"), change("expense", "prior_expense").alias("expense_change"), savings_rate("income", "expense").alias("savings_rate"))


def change(now: str, prior: str) -> Column:
    """Percent over the prior value; null if that is 0 or null."""
    p = F.col(prior).cast("double")
    return F.when(p != 0, F.round((F.col(now).cast("double") - p) / F.abs(p), 6) * 100)


def savings_rate(income: str, expense: str) -> Column:
    i = F.col(income).cast("double")
    return F.when(i > 0, F.round((i - F.col(expense).cast("double")) / i, 4) * 100).otherwise(F.lit(0.0))


def spend_by(ledger: DataFrame, key: str, month: Column | None = None, unknown: str = "Uncategorized") -> DataFrame:
    """Net expense and rows by user and a label."""
    rows = netted(ledger).where("txn_type = 'EXPENSE'")
    rows = rows if month is None else rows.where(month)
    return rows.groupBy("user_id", F.coalesce(key, F.lit(unknown)).alias(key)).agg(F.sum("net").alias("spent"), F.count("*").alias("rows"))


def top_per_user(spend: DataFrame, key: str, n: int) -> DataFrame:
    """The n labels with the highest spend of each user; ties by label."""
    order = Window.partitionBy("user_id").orderBy(F.desc("spent"), key)
    return spend.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def fold_rest(spend: DataFrame, key: str, n: int, label: str = "Other") -> DataFrame:
    """The top n labels; all others, and a label of that name, as ``label``; with shares in percent."""
    order = Window.partitionBy("user_id").orderBy(F.desc("spent"), key)
    named = spend.withColumn("label", F.when(F.row_number().over(order) <= n, F.col(key)).otherwise(F.lit(label)))
    sums = named.groupBy("user_id", "label").agg(F.sum("spent").alias("spent"))
    total = F.sum("spent").over(Window.partitionBy("user_id"))
    return sums.withColumn("share", F.round(F.col("spent").cast("double") / total.cast("double") * 100, 4))


def merchant_trend(ledger: DataFrame, anchor_month: str, months: int = 6) -> DataFrame:
    """Net spend of each user's merchants in the months up to the anchor, zeros included."""
    first = F.add_months(F.to_date(F.lit(anchor_month + "-01")), 1 - months)
    spine = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.date_format(F.add_months(first, i), "yyyy-MM"))
    rows = netted(ledger).where("txn_type = 'EXPENSE'").where((F.col("ym") >= F.date_format(first, "yyyy-MM")) & (F.col("ym") <= anchor_month))
    spent = rows.groupBy("user_id", "merchant", "ym").agg(F.sum("net").alias("spent"))
    every = rows.select("user_id", "merchant").distinct().withColumn("ym", F.explode(spine))
    return every.join(spent, ["user_id", "merchant", "ym"], "left").withColumn("spent", F.coalesce("spent", F.lit(0).cast("decimal(14,2)")))


def monthly_report(ledger: DataFrame, month: str) -> DataFrame:
    """Each user's net spend by category in a month, with refunds of all time, and the month's income and expense."""
    rows = netted(ledger).where(F.col("ym") == month)
    totals = rows.groupBy("user_id").agg(by_type("INCOME").alias("income"), by_type("EXPENSE").alias("expense"))
    parts = rows.where("txn_type = 'EXPENSE'").groupBy("user_id", F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.sum("net").alias("spent"))
    return totals.join(parts, "user_id", "left")


def budget_status(budgets: DataFrame, spend: DataFrame) -> DataFrame:
    """Every budget with what was spent (0 if nothing) and the percentage used."""
    spent = F.coalesce("spent", F.lit(0).cast("decimal(14,2)"))
    joined = budgets.join(spend, ["user_id", "category"], "left")
    return joined.select("user_id", "category", "limit_amount", spent.alias("spent"), (money.ratio(spent, F.col("limit_amount"), 4) * 100).alias("used"))


def balances(accounts: DataFrame) -> DataFrame:
    """Assets, card debt, net worth and balances by type; cards are debts."""
    kind = lambda k: F.sum(F.when(F.col("account_type") == k, F.col("balance")).otherwise(F.lit(0).cast("decimal(14,2)")))
    sums = accounts.groupBy("user_id").agg(kind("SAVINGS").alias("savings"), kind("WALLET").alias("wallet"), kind("INVESTMENT").alias("investment"), kind("CREDIT_CARD").alias("card_debt"))
    assets = F.col("savings") + F.col("wallet") + F.col("investment")
    return sums.withColumn("assets", assets).withColumn("net_worth", assets - F.col("card_debt"))


def health(ledger: DataFrame, accounts: DataFrame, months: int = 6, least_rows: int = 10) -> DataFrame:
    """Five factors and the overall score of every user with enough rows."""
    per = monthly(ledger)
    total = F.sum("rows").over(Window.partitionBy("user_id"))
    recent = per.withColumn("all_rows", total).withColumn("age", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ym")))).where((F.col("all_rows") >= least_rows) & (F.col("age") <= months))
    inc, exp = F.col("income").cast("double"), F.col("expense").cast("double")
    user = Window.partitionBy("user_id")
    mean = F.round(F.avg(exp).over(user), 6)
    stats = recent.withColumn("mean", mean).groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("mean").alias("mean"), F.avg(F.pow(exp - F.col("mean"), 2)).alias("var"), F.avg(F.when(inc >= exp, 1.0).otherwise(0.0)).alias("good"),
        F.max(F.when(F.col("age") == 1, inc)).alias("last_income"), F.max(F.when(F.col("age") == 1, exp)).alias("last_expense"),
    )
    cards = accounts.where("account_type = 'CREDIT_CARD' and credit_limit > 0").groupBy("user_id").agg(F.avg(F.round(F.col("balance").cast("double") / F.col("credit_limit").cast("double"), 6)).alias("used"))
    liquid = accounts.where("account_type in ('SAVINGS', 'WALLET')").groupBy("user_id").agg(F.sum("balance").cast("double").alias("liquid"))
    rows = stats.join(cards, "user_id", "left").join(liquid, "user_id", "left")
    clamp = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    savings = clamp(savings_rate("last_income", "last_expense"), 0, 30) / 30 * 100
    debt = F.when(F.col("used").isNull(), 100.0).otherwise(F.greatest(F.lit(0.0), 100 - F.col("used") * 100))
    have = F.coalesce("liquid", F.lit(0.0))
    reserve = F.when(F.col("mean") == 0, F.when(have > 0, 6.0).otherwise(0.0)).otherwise(have / F.col("mean"))
    emergency = F.least(reserve / 6, F.lit(1.0)) * 100
    cv = F.when((F.col("n") < 2) | (F.col("mean") == 0), F.lit(0.0)).otherwise(F.sqrt("var") / F.col("mean"))
    steady = F.greatest(F.lit(0.0), 100 - F.least(cv * 100, F.lit(100.0)))
    rows = rows.select("user_id", savings.alias("savings"), debt.alias("debt"), emergency.alias("emergency"), steady.alias("consistency"), (F.col("good") * 100).alias("cash_flow"))
    score = money.round_half_up(0.25 * F.col("savings") + 0.20 * F.col("debt") + 0.25 * F.col("emergency") + 0.15 * F.col("consistency") + 0.15 * F.col("cash_flow"))
    label = F.when(F.col("score") >= 80, "Excellent").when(F.col("score") >= 60, "Good").when(F.col("score") >= 40, "Fair").otherwise("Needs Attention")
    return rows.withColumn("score", score.cast("long")).withColumn("label", label)


def movers(ledger: DataFrame, as_of_month: str, prior_months: int = 3) -> DataFrame:
    """Categories of the newest data month against the mean of up to three data months before it."""
    rows = netted(ledger).where((F.col("txn_type") == "EXPENSE") & (F.col("ym") <= as_of_month))
    spent = rows.groupBy("user_id", "ym", F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(F.sum("net").alias("spent"))
    aged = spent.withColumn("age", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("ym")))).where(F.col("age") <= prior_months + 1)
    n_prior = F.max("age").over(Window.partitionBy("user_id")) - 1
    sums = aged.withColumn("n_prior", n_prior).groupBy("user_id", "category", "n_prior").agg(F.sum(F.when(F.col("age") == 1, F.col("spent"))).cast("double").alias("now"), F.sum(F.when(F.col("age") > 1, F.col("spent"))).cast("double").alias("before"))
    average = F.round(F.coalesce("before", F.lit(0.0)) / F.greatest(F.col("n_prior"), F.lit(1)), 4)
    return sums.where("now is not null").withColumn("prior_average", average).select("user_id", "category", "now", "prior_average", F.when(F.col("prior_average") > 0, F.round((F.col("now") - F.col("prior_average")) / F.col("prior_average"), 6) * 100).alias("pct"))


def insights(ledger: DataFrame, budgets: DataFrame, as_of_month: str, least: float = 15.0) -> DataFrame:
    """Sentences about every user's newest month: total, biggest category, movers, a missing budget."""
    moved = movers(ledger, as_of_month)
    user = Window.partitionBy("user_id")
    rupees = lambda c: F.format_string("₹%,d", F.round(c.cast("decimal(24,2)"), 0).cast("long"))
    total = moved.groupBy("user_id").agg(F.sum(F.col("now").cast("decimal(14,2)")).alias("total"))
    first = total.select("user_id", F.lit(1).alias("place"), F.concat(F.lit("You spent "), rupees(F.col("total")), F.lit(" this month.")).alias("sentence"))
    biggest = moved.withColumn("r", F.row_number().over(user.orderBy(F.desc("now"), "category"))).where("r = 1")
    second = biggest.select("user_id", F.lit(2).alias("place"), F.concat(F.lit("Biggest category: "), "category", F.lit(" at "), rupees(F.col("now")), F.lit(".")).alias("sentence"))
    strong = moved.where(F.abs(F.coalesce("pct", F.lit(0.0))) >= least).withColumn("r", F.row_number().over(user.orderBy(F.desc(F.abs("pct")), "category")))
    way = F.when(F.col("pct") > 0, F.lit(" is up ")).otherwise(F.lit(" is down "))
    moves = strong.where("r <= 3").select("user_id", (F.col("r") + 3).alias("place"), F.concat("category", way, F.format_string("%.0f", F.round(F.abs("pct"), 0)), F.lit("% on your average.")).alias("sentence"))
    unbudgeted = strong.join(budgets.select("user_id", "category"), ["user_id", "category"], "left_anti").withColumn("q", F.row_number().over(user.orderBy("r"))).where("q = 1")
    nudge = unbudgeted.select("user_id", F.lit(3).alias("place"), F.concat(F.lit("Consider a budget for "), "category", F.lit(".")).alias("sentence"))
    return first.unionByName(second).unionByName(nudge).unionByName(moves)


def recurring(ledger: DataFrame, least_rows: int = 3) -> DataFrame:
    """Merchants that charge at regular gaps and like amounts: label, means and the next date."""
    rows = ledger.where("duplicate_of is null and not is_transfer and txn_type = 'EXPENSE' and trim(merchant) != ''")
    group, order = Window.partitionBy("user_id", "merchant"), Window.partitionBy("user_id", "merchant").orderBy("txn_date", "txn_id")
    gaps = rows.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(order)))
    means = gaps.withColumn("avg_gap", F.avg("gap").over(group)).withColumn("avg_amount", F.round(F.sum("amount").over(group).cast("double") / F.count("*").over(group), 4))
    even = F.abs(F.col("gap") - F.col("avg_gap")) <= F.greatest(F.lit(5.0), 0.35 * F.col("avg_gap"))
    alike = F.abs(F.col("amount").cast("double") - F.col("avg_amount")) <= 0.2 * F.col("avg_amount") + 1
    found = means.groupBy("user_id", "merchant").agg(F.count("*").alias("rows"), F.max("avg_gap").alias("avg_gap"), F.max("avg_amount").alias("avg_amount"), F.max("txn_date").alias("last_date"), F.bool_and(F.coalesce(even, F.lit(True)) & alike).alias("regular"))
    found = found.where((F.col("rows") >= least_rows) & F.col("regular") & F.col("avg_gap").between(5, 95))
    label = F.when(F.col("avg_gap") < 10, "Weekly").when(F.col("avg_gap") < 20, "Biweekly").when(F.col("avg_gap") < 40, "Monthly").otherwise("Quarterly")
    return found.select("user_id", "merchant", "rows", "avg_gap", "avg_amount", label.alias("label"), F.expr("date_add(last_date, cast(floor(avg_gap + 0.5) as int))").alias("next_date"))


def notifications(ledger: DataFrame, accounts: DataFrame, budgets: DataFrame, month: str, threshold: float = 500) -> DataFrame:
    """Low savings or wallet balances, and budgets that net spend of the calendar month has reached."""
    low = accounts.where(F.col("account_type").isin("SAVINGS", "WALLET") & (F.col("balance") < threshold)).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit("LOW_BALANCE").alias("kind"), F.lit("").alias("category"), "n")
    spend = netted(ledger).where((F.col("txn_type") == "EXPENSE") & (F.col("ym") == month)).groupBy("user_id", "category").agg(F.sum("net").alias("spent"))
    over = budgets.where("limit_amount > 0").join(spend, ["user_id", "category"]).where("spent >= limit_amount").select("user_id", F.lit("BUDGET").alias("kind"), "category", F.lit(1).cast("long").alias("n"))
    return low.unionByName(over)
