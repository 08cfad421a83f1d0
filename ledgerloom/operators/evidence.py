"""How well a claim is assured: structure, corroboration and finance, each with the provenance it rests on.

Two pieces of evidence are independent if nothing upstream is common to both: the sets of their provenance nodes and all ancestors of these
are disjoint. Facts that say the same from the same ancestors are one before pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reconcile import saved

# Where a fact was seen, weakest first; from ROW_DATA on it is structural evidence.
SOURCES = ["DOCUMENT_TEXT", "SECTION_TEXT", "ROW_DATA", "COLUMN_HEADERS"]
PER_ROW, BALANCES = ["TRANSACTION_AMOUNT", "TRANSACTION_DIRECTION"], ["OPENING_BALANCE", "CLOSING_BALANCE"]


def ancestors(nodes: DataFrame, most: int = 32) -> DataFrame:
    """node and up: every node with itself and all its ancestors, from (node, parent), parent null at the top.

    Each round joins what is known with itself, so rounds follow the logarithm of the depth; a cycle ends like any other path. Deeper than
    2^``most`` is an error.
    """
    known = nodes.where("node is not null")
    pairs = saved(known.select("node", F.col("node").alias("up")).union(known.where("parent is not null").select("node", F.col("parent").alias("up"))).union(known.where("parent is not null").select(F.col("parent").alias("node"), F.col("parent").alias("up"))).distinct())
    count = pairs.count()
    for _ in range(most):
        further = saved(pairs.select("node", F.col("up").alias("mid")).join(pairs.select(F.col("node").alias("mid"), "up"), "mid").select("node", "up").distinct())
        grown = further.count()
        if grown == count:
            return pairs
        pairs, count = further, grown
    raise ValueError("provenance is too deep")


def assess(facts: DataFrame, nodes: DataFrame, finance: DataFrame) -> DataFrame:
    """claim_id, structural, corroboration, financial and status of every claim with a fact.

    ``facts``: claim_id, field, source, value and node; ``nodes``: node and parent; ``finance``: claim_id, chain (HOLDS, BROKEN or null), totals (VERIFIED, FAILED
    or null), cause and node. A dimension is SUPPORTED, CONFLICTING or INSUFFICIENT:

    structural: its strongest source is stronger than SECTION_TEXT. corroboration: two facts or more that all agree, two of them independent;
    CONFLICTING if values differ. financial: amounts and directions by the balance chain, balances by the statement's totals, where a mismatch caused by
    the opening balance speaks against that alone; nothing speaks for other fields. The claim conflicts if a dimension does, and is SUPPORTED by two
    supported dimensions that are independent, of the strongest fact, of all facts and of the check.

    Null values are no facts. Unknown nodes have only themselves upstream; a null node shares nothing.
    """
    up = ancestors(nodes)
    said = facts.where("claim_id is not null and value is not null").select("claim_id", "field", "value", F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")).alias("rank"), "node")
    lines = up.groupBy("node").agg(F.array_sort(F.collect_set("up")).alias("lines"))
    alone = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(F.array().cast("array<string>"))
    said = said.join(lines, "node", "left").withColumn("lines", F.coalesce("lines", alone))
    claims = said.groupBy("claim_id").agg(F.min("field").alias("field"), F.count("*").alias("facts"), F.count_distinct("value").alias("values"), F.max("rank").alias("rank"), F.max_by("lines", F.struct("rank", "lines")).alias("strongest"), F.array_distinct(F.flatten(F.collect_set("lines"))).alias("all_lines"))
    # the same lines with the same value once; one that nothing is known of is independent of any
    sets = said.groupBy("claim_id", "value", "lines").agg(F.count("*").alias("n"))
    pairs = sets.alias("x").join(sets.alias("y"), (F.col("x.claim_id") == F.col("y.claim_id")) & (F.col("x.value") == F.col("y.value")))
    apart = pairs.where(~F.arrays_overlap("x.lines", "y.lines") & ((F.col("x.lines") != F.col("y.lines")) | (F.col("x.n") > 1))).select(F.col("x.claim_id").alias("claim_id")).distinct().withColumn("independent", F.lit(True))
    checked = finance.join(lines, "node", "left").select("claim_id", "chain", "totals", "cause", F.coalesce("lines", alone).alias("check_lines"))
    rows = claims.join(apart, "claim_id", "left").join(checked, "claim_id", "left")
    structural = F.when(F.col("rank") > SOURCES.index("SECTION_TEXT") + 1, "SUPPORTED").otherwise("INSUFFICIENT")
    corroboration = F.when(F.col("facts") < 2, "INSUFFICIENT").when(F.col("values") > 1, "CONFLICTING").when(F.col("independent"), "SUPPORTED").otherwise("INSUFFICIENT")
    per_row = F.when(F.col("chain") == "BROKEN", "CONFLICTING").when(F.col("chain") == "HOLDS", "SUPPORTED")
    whole = F.when(F.col("totals") == "VERIFIED", "SUPPORTED").when((F.col("totals") == "FAILED") & (F.col("cause") == "OPENING_BALANCE") & (F.col("field") == "OPENING_BALANCE"), "CONFLICTING")
    financial = F.coalesce(F.when(F.col("field").isin(PER_ROW), per_row).when(F.col("field").isin(BALANCES), whole), F.lit("INSUFFICIENT"))
    rows = rows.select("claim_id", structural.alias("structural"), corroboration.alias("corroboration"), financial.alias("financial"), "strongest", "all_lines", F.coalesce("check_lines", F.array().cast("array<string>")).alias("check_lines"))
    holds = lambda c: F.col(c) == "SUPPORTED"
    both = lambda a, b, x, y: holds(a) & holds(b) & ~F.arrays_overlap(x, y)
    supported = both("structural", "corroboration", "strongest", "all_lines") | both("structural", "financial", "strongest", "check_lines") | both("corroboration", "financial", "all_lines", "check_lines")
    conflict = F.array_contains(F.array("structural", "corroboration", "financial"), "CONFLICTING")
    return rows.select("claim_id", "structural", "corroboration", "financial", F.when(conflict, "CONFLICTING").when(supported, "SUPPORTED").otherwise("INSUFFICIENT").alias("status"))
