"""Categories, rules, merchants and what is learnt of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .folds import folded

#: Rules in one block, and blocks of them that are broadcast.
BLOCK_RULES, MAX_BLOCKS = 1000, 8


def rule_matches(rows: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """Every enabled rule that holds for a row, with the rule's columns.

    Text operators ignore case; a null field, a bad number or a bad range never matches.
    GLOBAL rules hold for all users, USER rules for their own. A row meets its rules as arrays: those of its
    user by an equi-join, the global ones in blocks of BLOCK_RULES, each a row that is joined by its number, so a
    few blocks are broadcast and many are shuffled. Rules are read once for the number of blocks.
    """
    number = F.expr("try_cast(value as decimal(14,2))")
    first, second = (F.expr(f"try_cast(try_element_at(split(value, ','), {k}) as decimal(14,2))") for k in (1, 2))
    pair = F.size(F.split("value", ",")) == 2
    rule = F.struct("rule_id", "scope", "priority", "action", "target", "field", "operator", F.lower("value").alias("want"), number.alias("number"), F.when(pair, first).alias("low"), F.when(pair, second).alias("high"))
    shared = rules.where("rule_user is null")
    blocks = max(1, -(-shared.count() // BLOCK_RULES))
    packed = shared.groupBy(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(rule).alias("shared"))
    own = rules.where("rule_user is not null").groupBy(F.col("rule_user").alias("user_id")).agg(F.collect_list(rule).alias("own"))
    told = rows.withColumns({"_description": F.lower("description"), "_merchant": F.lower("merchant"), "_amount": F.col("amount").cast("string")})
    met = told.join(own, "user_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.join(F.broadcast(packed) if blocks <= MAX_BLOCKS else packed, "block", "left")
    none = F.array().cast(packed.schema["shared"].dataType)
    every = F.concat(F.when(F.col("block") == 0, F.coalesce("own", none)).otherwise(none), F.coalesce("shared", none))

    def holds(r):
        text_of = F.when(r["field"] == "DESCRIPTION", F.col("_description")).when(r["field"] == "MERCHANT", F.col("_merchant")).when(r["field"] == "AMOUNT", F.col("_amount"))
        is_amount, operator = r["field"] == "AMOUNT", r["operator"]
        found = (
            F.when(operator == "CONTAINS", F.contains(text_of, r["want"]))
            .when(operator == "STARTS_WITH", F.startswith(text_of, r["want"]))
            .when((operator == "EQUALS") & is_amount, F.col("amount") == r["number"])
            .when(operator == "EQUALS", text_of == r["want"])
            .when((operator == "GREATER_THAN") & is_amount, F.col("amount") > r["number"])
            .when((operator == "LESS_THAN") & is_amount, F.col("amount") < r["number"])
            .when((operator == "BETWEEN") & is_amount, F.col("amount").between(r["low"], r["high"]))
        )
        return F.coalesce(found, F.lit(False))

    found = met.select(*keep, F.explode(F.filter(every, holds)).alias("rule"))
    return found.select(*keep, *[F.col(f"rule.{c}").alias(c) for c in ("rule_id", "scope", "priority", "action", "target")])


def first_rule(matches: DataFrame, key: str = "txn_id") -> DataFrame:
    """The category rule that wins: users' own before global ones, then priority, then id."""
    own = F.when(F.col("scope") == "USER", 0).otherwise(1)
    order = Window.partitionBy(key).orderBy(own, "priority", "rule_id")
    return matches.where("action = 'ASSIGN_CATEGORY'").withColumn("place", F.row_number().over(order)).where("place = 1").select(key, "rule_id", "target")


def side_effects(matches: DataFrame, key: str = "txn_id") -> DataFrame:
    """What all matching rules but category ones do: transfer and subscription marks, tags, and an investment's category.

    Of several MARK_INVESTMENT rules the last one counts, users' own coming before global ones, then by priority
    and id; without a name it is Investments. Blank tags are none.
    """
    is_a = lambda action: F.col("action") == action
    named = F.when(F.trim("target") != "", F.col("target"))
    turn = F.struct(F.when(F.col("scope") == "USER", 0).otherwise(1), "priority", "rule_id")
    return matches.where("action != 'ASSIGN_CATEGORY'").groupBy(key).agg(
        F.bool_or(is_a("MARK_TRANSFER")).alias("mark_transfer"),
        F.bool_or(is_a("MARK_SUBSCRIPTION")).alias("mark_subscription"),
        F.max_by(F.coalesce(named, F.lit("Investments")), F.when(is_a("MARK_INVESTMENT"), turn)).alias("investment"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_a("ADD_TAG"), named))), ",").alias("tags"),
    )


def top_learnt(learning: DataFrame) -> DataFrame:
    """Each merchant's category with most confirmations, then the latest, and its share in percent."""
    pair = Window.partitionBy("user_id", "merchant")
    ranked = learning.withColumn("place", F.row_number().over(pair.orderBy(F.desc("confirmations"), F.desc("last_at"), "category_id"))).withColumn("total", F.sum("confirmations").over(pair))
    return ranked.where("place = 1").select("user_id", "merchant", "category_id", "confirmations", percent("confirmations", "total").alias("confidence"))


def percent(part: str, whole: str) -> Column:
    return F.floor(F.col(part) * 100 / F.col(whole) + 0.5).cast("long")


def confidences(learning: DataFrame) -> DataFrame:
    """Every category's share of its merchant's confirmations."""
    total = F.sum("confirmations").over(Window.partitionBy("user_id", "merchant"))
    return learning.withColumn("total", total).where("total > 0").select("user_id", "merchant", "category_id", percent("confirmations", "total").alias("confidence"))


def cascade(rows: DataFrame, rules: DataFrame, learnt: DataFrame) -> DataFrame:
    """The suggested category: rule, then learnt, then keyword, then Other, and where it came from."""
    ruled = first_rule(rule_matches(rows, rules, ["txn_id"]))
    word = text.keyword_category(F.col("description"))
    joined = rows.join(ruled, "txn_id", "left").join(learnt.select("user_id", "merchant", F.concat(F.lit("Category "), F.col("category_id")).alias("learnt")), ["user_id", "merchant"], "left")
    source = F.when(F.col("target").isNotNull(), "RULE").when(F.col("learnt").isNotNull(), "LEARNED_PATTERN").when(word != "Other", "KEYWORD_MATCH").otherwise("DEFAULT")
    return joined.select("txn_id", F.coalesce("target", "learnt", word).alias("suggested"), source.alias("decision"))


def resolve_merchants(rows: DataFrame, aliases: DataFrame, merchants: DataFrame) -> DataFrame:
    """Each row's merchant by its exact alias, else by its first significant token, else none.

    Of the merchants with one token the first by id counts.
    """
    by_token = merchants.withColumn("token", text.significant_token(F.col("name"))).where("token is not null").groupBy("user_id", "token").agg(F.min("merchant_id").alias("by_token"))
    keyed = rows.withColumn("alias", text.normalize(F.col("description"))).withColumn("token", text.significant_token(F.col("description")))
    joined = keyed.join(aliases.select("user_id", "alias", F.col("merchant_id").alias("by_alias")), ["user_id", "alias"], "left").join(by_token, ["user_id", "token"], "left")
    how = F.when(F.col("by_alias").isNotNull(), "ALIAS").when(F.col("by_token").isNotNull(), "TOKEN").otherwise("NONE")
    return joined.select("txn_id", "user_id", F.coalesce("by_alias", "by_token").alias("merchant_id"), how.alias("how"))


def create_merchants(rows: DataFrame) -> DataFrame:
    """Merchants that rows, taken in order, would create: one a user and token, named by its first row, with its aliases.

    Rows without a token make one merchant for each normalised text.
    """
    norm = F.col("alias")
    plain = rows.select("user_id", "txn_date", "txn_id", text.normalize(F.col("description")).alias("alias"))
    keyed = plain.select("*", F.coalesce(text.token_of(norm), F.concat(F.lit("="), norm)).alias("key"), text.once(text.merchant_of(norm), text.display_name).alias("name"))
    return keyed.groupBy("user_id", "key").agg(F.min_by("name", F.struct("txn_date", "txn_id")).alias("name"), F.count_distinct("alias").alias("aliases"), F.count("*").alias("rows"))


def merge_merchants(learning: DataFrame, merges: DataFrame) -> DataFrame:
    """Confirmations after merchants are merged: keys remapped, counts summed, the latest time, shares anew."""
    named = learning.join(merges.select("merchant", "into"), "merchant", "left").withColumn("merchant", F.coalesce("into", "merchant"))
    summed = named.groupBy("user_id", "merchant", "category_id").agg(F.sum("confirmations").alias("confirmations"), F.max("last_at").alias("last_at"))
    return summed.join(confidences(summed), ["user_id", "merchant", "category_id"])


def category_confidence(learnt: DataFrame) -> DataFrame:
    """Mean confidence and merchants of each top category."""
    return learnt.groupBy("category_id").agg(F.floor(F.avg("confidence") + 0.5).cast("long").alias("confidence"), F.count("*").alias("merchants"))


def replay(events: DataFrame) -> DataFrame:
    """Counts after an ordered log of CONFIRM, UNDO and RESET, and what each confirmation was: LEARNED or CORRECTED.

    Returns, for a user's merchant, its counts by category and both tallies. UNDO
    takes back the last confirmation, once, unless something other than a confirmation
    came in between; counts at 0 are dropped. The log is folded in order, with one merchant's counts at a time.
    """

    def start():
        return {"counts": {}, "last": None, "learned": 0, "corrected": 0}

    def step(state, row):
        kind, category = row[2], row[3]
        counts = state["counts"]
        if kind == "RESET":
            counts.clear()
            state["last"] = None
        elif kind == "UNDO":
            if state["last"] is not None:
                counts[state["last"]] -= 1
                if counts[state["last"]] <= 0:
                    del counts[state["last"]]
            state["last"] = None
        else:
            top = max(counts, key=lambda c: (counts[c], -c)) if counts else None
            state["learned" if top is None or top == category else "corrected"] += 1
            counts[category] = counts.get(category, 0) + 1
            state["last"] = category
        return ()

    def finish(key, state):
        tallies = (state["learned"], state["corrected"])
        return [(*key, c, n, *tallies) for c, n in sorted(state["counts"].items())] or [(*key, None, 0, *tallies)]

    schema = "user_id long, merchant string, category_id long, confirmations long, learned long, corrected long"
    rows = events.select("user_id", "merchant", "kind", "category_id", "ts", "event_id")
    return folded(rows, ["user_id", "merchant"], ["ts", "event_id"], start, step, schema, finish)


def match_products(found: DataFrame, known: DataFrame) -> DataFrame:
    """How each found product (found_id, institution, number) is known: EXACT by identity key, PROBABLE by institution and last four digits, else NONE."""
    last4 = lambda c: F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(4))
    exact = known.select(text.identity_key(F.col("institution"), F.col("number")).alias("identity")).where("identity is not null").distinct().withColumn("exact", F.lit(True))
    near = known.select("institution", last4("number").alias("last4")).where("length(last4) = 4").distinct().withColumn("near", F.lit(True))
    keyed = found.withColumn("identity", text.identity_key(F.col("institution"), F.col("number"))).withColumn("last4", last4("number"))
    joined = keyed.join(exact, "identity", "left").join(near, ["institution", "last4"], "left")
    return joined.select("found_id", F.when(F.col("exact"), "EXACT").when(F.col("near"), "PROBABLE").otherwise("NONE").alias("match"))


def explain(ledger: DataFrame, ruled: DataFrame, rules: DataFrame) -> DataFrame:
    """A sentence on each row's category by its decision's source."""
    known = rules.select("rule_id", "field", "operator", "value")
    joined = ledger.join(ruled, "txn_id", "left").join(known, "rule_id", "left")
    rule = F.when(F.col("rule_id").isNull(), F.lit("The rule is no longer available")).otherwise(F.concat_ws(" ", F.lower("field"), F.lower("operator"), F.col("value"), F.lit("→"), F.col("target")))
    source = F.col("decision_source")
    line = F.when(source.isin("GLOBAL_RULE", "USER_RULE"), rule).when(source == "LEARNED_PATTERN", F.lit("Learnt from earlier choices")).when(source == "KEYWORD_MATCH", F.lit("A keyword of the description")).when(source == "MANUAL", F.lit("Set by hand")).when(source == "FILE_PROVIDED", F.lit("Given in the file")).otherwise(F.lit("The merchant's default"))
    return joined.select("txn_id", line.alias("explanation"))
