"""Which financial product a section shows: hypotheses of expected, forbidden and proving signals, as sets of bits.

A section's facts become one set of signals for each place they were seen in; every hypothesis is scored by counting bits. Facts are
aggregated before the 13 hypotheses meet them, so a section of any size is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signals, and types with what they expect, forbid and are proved by; the last says that the type must be named.
# Their order is the order of ties.
SIGNALS = [
    "DATE_COLUMN", "DESCRIPTION_COLUMN", "DEBIT_CREDIT_COLUMNS", "SINGLE_AMOUNT_COLUMN", "RUNNING_BALANCE_COLUMN", "TRANSACTION_ROWS", "OPENING_BALANCE_FIELD", "CLOSING_BALANCE_FIELD", "MATURITY_FIELD",
    "INTEREST_RATE_FIELD", "PRINCIPAL_FIELD", "INSTALLMENT_FIELD", "MINIMUM_DUE_FIELD", "TOTAL_DUE_FIELD", "CREDIT_LIMIT_FIELD", "CARD_NUMBER_FIELD", "EMI_FIELD", "OUTSTANDING_FIELD", "TENURE_FIELD", "PRODUCT_NAME",
]
_LEDGER = ["DATE_COLUMN", "DESCRIPTION_COLUMN", "DEBIT_CREDIT_COLUMNS", "RUNNING_BALANCE_COLUMN", "TRANSACTION_ROWS"]
_NAMED = ([], ["DESCRIPTION_COLUMN", "MINIMUM_DUE_FIELD"], [], True)
HYPOTHESES = {
    "SAVINGS": ([*_LEDGER, "OPENING_BALANCE_FIELD", "CLOSING_BALANCE_FIELD"], ["MATURITY_FIELD", "INSTALLMENT_FIELD", "EMI_FIELD", "MINIMUM_DUE_FIELD", "TOTAL_DUE_FIELD"], ["DATE_COLUMN", "DESCRIPTION_COLUMN", "TRANSACTION_ROWS", "OPENING_BALANCE_FIELD", "CLOSING_BALANCE_FIELD"], False),
    "CURRENT": (_LEDGER, ["MATURITY_FIELD", "INSTALLMENT_FIELD", "EMI_FIELD", "MINIMUM_DUE_FIELD"], ["DATE_COLUMN", "DESCRIPTION_COLUMN", "TRANSACTION_ROWS"], True),
    "OVERDRAFT": (["DATE_COLUMN", "DESCRIPTION_COLUMN", "RUNNING_BALANCE_COLUMN", "TRANSACTION_ROWS", "CREDIT_LIMIT_FIELD"], ["MATURITY_FIELD", "INSTALLMENT_FIELD", "MINIMUM_DUE_FIELD"], ["DATE_COLUMN", "TRANSACTION_ROWS"], True),
    "WALLET": (["DATE_COLUMN", "DESCRIPTION_COLUMN", "TRANSACTION_ROWS", "RUNNING_BALANCE_COLUMN"], ["MATURITY_FIELD", "INSTALLMENT_FIELD", "EMI_FIELD", "CREDIT_LIMIT_FIELD"], ["DATE_COLUMN", "TRANSACTION_ROWS"], True),
    "CREDIT_CARD": (["MINIMUM_DUE_FIELD", "TOTAL_DUE_FIELD", "CREDIT_LIMIT_FIELD", "CARD_NUMBER_FIELD", "DATE_COLUMN", "DESCRIPTION_COLUMN"], ["MATURITY_FIELD", "INSTALLMENT_FIELD", "OPENING_BALANCE_FIELD"], ["CARD_NUMBER_FIELD", "TOTAL_DUE_FIELD"], False),
    "RECURRING_DEPOSIT": (["INSTALLMENT_FIELD", "MATURITY_FIELD", "DATE_COLUMN", "INTEREST_RATE_FIELD"], ["DESCRIPTION_COLUMN", "MINIMUM_DUE_FIELD", "EMI_FIELD"], ["INSTALLMENT_FIELD", "MATURITY_FIELD"], False),
    "FIXED_DEPOSIT": (["MATURITY_FIELD", "INTEREST_RATE_FIELD", "PRINCIPAL_FIELD", "DATE_COLUMN"], ["DESCRIPTION_COLUMN", "INSTALLMENT_FIELD", "MINIMUM_DUE_FIELD", "EMI_FIELD"], ["PRINCIPAL_FIELD", "INTEREST_RATE_FIELD", "MATURITY_FIELD"], False),
    "LOAN": (["EMI_FIELD", "OUTSTANDING_FIELD", "TENURE_FIELD", "INTEREST_RATE_FIELD"], ["MINIMUM_DUE_FIELD", "CARD_NUMBER_FIELD"], ["OUTSTANDING_FIELD", "EMI_FIELD"], False),
    "PPF": _NAMED, "EPF": _NAMED, "NPS": _NAMED, "DEMAT": _NAMED, "MUTUAL_FUND": _NAMED,
}
#: Places of evidence, strongest first, and what a signal there is worth.
PLACES = {"COLUMN_HEADERS": 1.0, "ROW_DATA": 0.8, "SECTION_TEXT": 0.6, "DOCUMENT_TEXT": 0.15}
LEAST, MOST, CORROBORATING = 0.6, 0.95, 2


def bits(names: list[str]) -> int:
    return sum(1 << SIGNALS.index(n) for n in names)


def classify(facts: DataFrame) -> DataFrame:
    """doc_id, product, score and verdict of every section's facts (doc_id, place, signal, named).

    A hypothesis is out if a signal that it forbids was seen in the section itself, if it must be named there and isn't, or if fewer than
    two signals support it (a type without expected signals needs its name only, whose place is its score). Its score is the weight of the expected signals' strongest
    places over their number; its name adds its place's weight to both. The first of the best hypotheses wins; its score counts up to ``MOST``,
    under ``LEAST`` the product is UNKNOWN. verdict: VALIDATED if all proving signals were seen, UNPROVEN if one is missing or the type has none,
    UNIDENTIFIED without a product.

    Repeated facts count once; unknown signals and places, and null ids, are left out, but their section is kept.
    """
    # where a name is in a list, as a bit
    bit_of = lambda column, names: F.when(F.col(column).isin(names), F.expr("shiftleft(1L, cast(array_position(array(" + ", ".join(f"'{n}'" for n in names) + f"), {column}) - 1 as int))"))
    types = list(HYPOTHESES)
    rows = facts.where("doc_id is not null").withColumn("bit", bit_of("signal", SIGNALS)).withColumn("name", F.when(F.col("signal") == "PRODUCT_NAME", bit_of("named", types)))
    seen = rows.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(F.when(F.col("place") == p, F.col(c))), F.lit(0).cast("long")).alias(f"{c}_{k}") for c in ("bit", "name") for k, p in enumerate(PLACES)])
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("type"), F.lit(bits(e)).cast("long").alias("expected"), F.lit(bits(f)).cast("long").alias("forbidden"), F.lit(bits(p)).cast("long").alias("proof"), F.lit(must).alias("must"), F.lit(1 << n).cast("long").alias("own")) for n, (t, (e, f, p, must)) in enumerate(HYPOTHESES.items())])
    every = seen.select("*", F.inline(table))
    count = F.bit_count
    both = lambda a, b: F.col(a).bitwiseAND(F.col(b) if isinstance(b, str) else b)
    mask, earned, stronger = None, F.lit(0.0), F.lit(0).cast("long")
    place_of_name: Column = F.lit(0.0)
    for k, weight in reversed(list(enumerate(PLACES.values()))):
        place_of_name = F.when(both(f"name_{k}", "own") != 0, F.lit(weight)).otherwise(place_of_name)
    for k, weight in enumerate(PLACES.values()):
        here = both("expected", f"bit_{k}")
        earned = earned + weight * count(here.bitwiseAND(F.bitwise_not(stronger)))
        stronger = stronger.bitwiseOR(here)
        mask = F.col(f"bit_{k}") if mask is None else mask.bitwiseOR(F.col(f"bit_{k}"))
    inside = F.col("bit_0").bitwiseOR(F.col("bit_1")).bitwiseOR(F.col("bit_2"))
    named_inside = F.col("name_0").bitwiseOR(F.col("name_1")).bitwiseOR(F.col("name_2")).bitwiseAND(F.col("own")) != 0
    # as decimals, so that equal scores tie whatever the order of their sums
    exact = F.round((earned + place_of_name) / (count("expected") + place_of_name), 9)
    support = count(stronger) + named_inside.cast("int")
    out = (F.col("forbidden").bitwiseAND(inside) != 0) | (F.col("must") & ~named_inside)
    score = F.when(out, 0.0).when(F.col("expected") == 0, place_of_name).when(support < CORROBORATING, 0.0).otherwise(F.least(F.lit(MOST), exact))
    scored = every.select("doc_id", "n", "type", score.alias("score"), ((F.col("proof") != 0) & (F.col("proof").bitwiseAND(F.bitwise_not(mask)) == 0)).alias("proved"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("type", "proved", "score"), F.struct("score", -F.col("n"))).alias("b"))
    top = F.least(F.col("b.score"), F.lit(MOST))
    sure = top >= LEAST
    return best.select("doc_id", F.when(sure, F.col("b.type")).otherwise("UNKNOWN").alias("product"), F.round(top, 6).alias("score"), F.when(~sure, "UNIDENTIFIED").when(F.col("b.proved"), "VALIDATED").otherwise("UNPROVEN").alias("verdict"))
