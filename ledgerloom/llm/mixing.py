"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Sources share the corpus's words by weight, none above ``repeat`` times its own. The
shares are cut into equal blocks of words, which the sources get by highest
quotients share / (2 k + 1); a source's blocks go to its shards the same way, by their words.
A shard lays its documents out in seeded order and takes its quota of blocks
from that stream: whole passes first, then a prefix, of which only the last
document may be cut. Shards hold a bounded number of documents, so no task
sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: A source's shards; their sizes and quotas are one row each.
MAX_SHARDS = 1 << 16
#: Sources are ranked among each other in one task, a row of some numbers each; more than this are refused.
MAX_SOURCES = 1 << 20
#: Sources whose rows, of some numbers each, are broadcast.
FEW_SOURCES = 20_000


def words(text_col: str = "text") -> Column:
    """Count of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, id_col: str = "doc_id") -> Column:
    """A number of 60 bits drawn from the seed and a document's id (null: empty)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, repeat: int = 3) -> DataFrame:
    """Adds target to (source, source_size, weight).

    Each source's share of all words goes by weight, until it reaches ``repeat`` times its
    size; the excess is shared again by weight until none is above. One row for a
    source: sorted by cap over weight, the first ones are full exactly while the level
    that the others share is above theirs.
    """
    cap = F.col("source_size") * F.lit(float(repeat))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    staged = (
        sources.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything).cast("double"))
        .withColumn("full_words", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(before), F.lit(0)).cast("double"))
        .withColumn("level", (F.col("all_words") - F.col("full_words")) / (F.col("all_weight") - F.col("full_weight")))
        .withColumn("full", cap <= F.col("level") * F.col("weight"))
    )
    staged = staged.withColumn("place", F.row_number().over(order))
    # the first that isn't full sets the level, and those behind it share by it too
    first = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)
    staged = staged.withColumn("first", first)
    return staged.withColumn("target", F.when(F.col("place") < F.col("first.place"), cap).otherwise(F.coalesce(F.col("first.level") * F.col("weight"), F.lit(0.0)))).select(*sources.columns, "target")


def apportion(parts: DataFrame, over: list[str], share: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë's seats of each row within its group.

    share: the row's claim (0: no seat); seats: the group's seats, the same on all its rows.
    Rounding each exact share to the nearest whole gives the seats of one
    divisor, so only the difference is left to deal: as many highest (or lowest)
    quotients as the group is short of (or over). Equal quotients go by ``order``.
    """
    group = Window.partitionBy(*over) if over else Window.partitionBy()
    exact = F.when(F.sum(share).over(group) > 0, F.col(share) * F.col(seats) / F.sum(share).over(group)).otherwise(F.lit(0.0))
    rounded = parts.withColumn("_start", F.floor(exact + F.lit(0.5)).cast("long"))
    rounded = rounded.withColumn("_short", (F.col(seats) - F.sum("_start").over(group)).cast("long"))
    # The divisor that gives all seats is within a factor 1 +- rows / (2 seats) of this one, so a
    # row's seats change by at most its exact share times that, and one: a number of offers in
    # proportion to the rows. They go upwards if short, downwards if over.
    most = F.floor(exact * F.count("*").over(group) / (2 * F.greatest(F.col(seats), F.lit(1)))).cast("long") + 2
    rounded = rounded.withColumn("_offers", F.when(F.col(share) <= 0, 0).when(F.col("_short") >= 0, F.least(F.col("_short"), most)).otherwise(F.least(-F.col("_short"), F.col("_start"), most)))
    steps = F.when(F.col("_offers") > 0, F.sequence(F.lit(0).cast("long"), F.col("_offers") - 1)).otherwise(F.array().cast("array<long>"))
    keys = [*over, *order]
    offers = rounded.select(*keys, "_short", F.col(share).alias("_share"), "_start", F.explode(steps).alias("_k"))
    seat = F.when(F.col("_short") > 0, F.col("_start") + F.col("_k")).otherwise(F.col("_start") - 1 - F.col("_k"))
    quotient = F.col("_share") / (2 * seat + 1)
    # the last of equal quotients was dealt last, so it is the first to be taken back
    group = Window.partitionBy(*over, F.sign("_short")) if over else Window.partitionBy(F.sign("_short"))
    up = group.orderBy(-quotient, *[F.col(c).asc_nulls_last() for c in order], "_k")
    down = group.orderBy(quotient, *[F.col(c).desc_nulls_first() for c in order], "_k")
    rank = F.when(F.col("_short") > 0, F.row_number().over(up)).otherwise(F.row_number().over(down))
    dealt = offers.withColumn("_rank", rank).where(F.col("_rank") <= F.abs("_short")).groupBy(*keys).agg(F.sum(F.sign("_short")).cast("long").alias("_more"))
    same = None
    renamed = dealt.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(keys)], "_more")
    for i, c in enumerate(keys):
        same = (rounded[c].eqNullSafe(renamed[f"_r{i}"])) if same is None else same & rounded[c].eqNullSafe(renamed[f"_r{i}"])
    return rounded.join(renamed, same, "left").select(*parts.columns, (F.col("_start") + F.coalesce(F.col("_more"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, block_words: int = 64, shard_rows: int = 256, repeat: int = 3, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes and extra of every row.

    taken = passes * size + extra words; extra < size is a prefix of the document in its
    shard's last pass. The sources, by code point with null last, weigh 1, 2, 3, 1, ...
    Quotas count blocks of ``block_words``, or of the smallest target if that is less. A target
    under one word may get none. Null texts have size 0 and take nothing. A row's place follows from its id
    and size alone, so reruns agree; rows alike in both tie, and any order of them gives
    the same result.
    """
    # a few numbers a row, read by all that follows, so texts are read once
    named = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source")]
    sized = checkpointed(docs.select(*named, words(text_col).alias("size"), seeded(seed, id_col).alias("_seed")))
    sources = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    number_of_sources = sources.count()
    if number_of_sources > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them before mixing")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = targets(sources.withColumn("weight", (number - 1) % 3 + 1), repeat)
    # no block is larger than the smallest target, else small sources would get none
    smallest = F.min(F.when(F.col("target") >= 1, F.floor("target"))).over(Window.partitionBy())
    sources = sources.withColumn("_block", F.coalesce(F.least(F.lit(block_words), smallest), F.lit(1)).cast("long"))
    sources = sources.withColumn("_blocks", F.floor(F.sum("target").over(Window.partitionBy()) / F.col("_block") + 0.5).cast("long"))
    sources = apportion(sources, [], "target", "_blocks", ["source"])
    sources = sources.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "source_size", "target", "_block", F.least(F.ceil(F.col("_rows") / shard_rows), F.lit(MAX_SHARDS)).cast("int").alias("_shards"), F.col("quota").alias("_source_quota"))

    keyed = sized.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    # a source may hold a third of all rows: without a known partitioning by source, the join may be split and shards are dealt out anew
    sources = F.broadcast(sources) if number_of_sources <= FEW_SOURCES else sources
    placed = keyed.join(sources, ["_source", "_none"]).withColumn("_source", F.concat("_source", F.lit(""))).withColumn("_shard", F.pmod(F.col("_seed"), F.col("_shards")).cast("int"))
    by = ["_source", "_none", "_shard"]
    shards = placed.groupBy(*by).agg(F.sum("size").alias("_shard_size"), F.first("_source_quota").alias("_source_quota"), F.first("_block").alias("_block"))
    shards = apportion(shards, ["_source", "_none"], "_shard_size", "_source_quota", ["_shard"])
    shards = shards.select(*by, "_shard_size", F.least(F.col("quota") * F.col("_block"), F.col("_shard_size") * repeat).alias("_words"))

    stream = Window.partitionBy(*by).orderBy("_seed", "doc_id", "size")
    laid = placed.join(shards, by).withColumn("_start", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    passes = F.when(F.col("_shard_size") > 0, F.floor(F.col("_words") / F.col("_shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("_words") - passes * F.col("_shard_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start"))).cast("long")
    laid = laid.withColumn("passes", passes).withColumn("extra", extra)
    return laid.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), "passes", "extra", "_seed")


def apply(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each taken pass is a row, and a cut document's last row has its first ``extra`` words.

    Documents of which nothing is taken go; of the rest each row is whole but for that cut.
    """
    columns = docs.columns
    plan = mix(docs, text_col=text_col, **options).where("taken > 0")
    plan = plan.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__mix_id"), F.col("doc_id").isNull().alias("__mix_null"), F.col("size").alias("__mix_size")).agg(F.sort_array(F.collect_list(F.struct("passes", "extra", "size"))).alias("__mix_plans"))
    rows = docs.withColumn("__mix_id", F.coalesce("doc_id", F.lit(0))).withColumn("__mix_null", F.col("doc_id").isNull()).withColumn("__mix_size", words(text_col))
    key = ["__mix_id", "__mix_null", "__mix_size"]
    plan = checkpointed(plan)
    joined = rows.join(plan, key)
    if (plan.agg(F.max(F.size("__mix_plans"))).head()[0] or 0) > 1:
        # of rows alike in id and size the n-th takes the n-th plan; any order of them will do
        joined = joined.withColumn("__mix_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        both = joined.withColumn("__mix_plan", F.get("__mix_plans", F.col("__mix_n") - 1)).where("__mix_plan is not null")
    else:
        both = joined.withColumn("__mix_plan", F.col("__mix_plans")[0])
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__mix_plan.extra").cast("int")), "")
    whole = F.col("__mix_plan.passes") + F.when(F.col("__mix_plan.extra") == F.col("__mix_plan.size"), 1).otherwise(0)
    part = (F.col("__mix_plan.extra") > 0) & (F.col("__mix_plan.extra") < F.col("__mix_plan.size"))
    texts = F.concat(F.array_repeat(F.col(text_col), whole.cast("int")), F.when(part, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return both.withColumn(text_col, F.explode(texts)).select(*columns)
