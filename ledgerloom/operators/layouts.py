"""Layout registry and import intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money


def fingerprint(fmt: Column, headers: Column) -> Column:
    """FP-1- and eight hex digits of the format, header count and sorted distinct headers."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(headers, lambda h: F.lower(F.trim(h))))), ",")
    return F.concat(F.lit("FP-1-"), F.upper(F.substring(F.sha2(F.concat_ws("|", fmt, F.size(headers).cast("string"), names), 256), 1, 8)))


def summary(imports: DataFrame) -> DataFrame:
    """Use, first and last day, rows and the upper median duration of each layout."""
    return imports.groupBy("fingerprint").agg(F.count("*").alias("uses"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("rows").alias("rows"), money.upper_median(F.collect_list("duration")).alias("median"))


def with_registry(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Layouts of imports and registry: the registry's name and days win, layouts only in it have zeros."""
    joined = found.join(registry, "fingerprint", "full_outer")
    return joined.select("fingerprint", F.coalesce("name", F.lit("unnamed")).alias("name"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("registered_first", "first_day").alias("first_day"), F.coalesce("registered_last", "last_day").alias("last_day"))


def capabilities(events: DataFrame, key: str = "fingerprint") -> DataFrame:
    """For each layout and capability, whether all its imports had it."""
    size = events.groupBy(key).agg(F.count_distinct("import_id").alias("imports"))
    used = events.where("capability is not null").groupBy(key, "capability").agg(F.count_distinct("import_id").alias("with"))
    return used.join(size, key).select(key, "capability", "with", (F.col("with") == F.col("imports")).alias("stable"))


def coverage(events: DataFrame, known: DataFrame) -> DataFrame:
    """Activations of each known capability and their share of imports; 0 if never active."""
    total = events.agg(F.count_distinct("import_id").alias("imports"))
    used = events.groupBy("capability").agg(F.count_distinct("import_id").alias("activations"))
    return known.join(used, "capability", "left").join(F.broadcast(total)).select("capability", F.coalesce("activations", F.lit(0)).alias("activations"), F.round(F.coalesce("activations", F.lit(0)) / F.col("imports"), 6).alias("ratio"))


def unknown_headers(headers: DataFrame) -> DataFrame:
    """Imports, layouts and days of each unknown header."""
    return headers.groupBy("header").agg(F.count_distinct("import_id").alias("imports"), F.count_distinct("fingerprint").alias("layouts"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def encounters(imports: DataFrame) -> DataFrame:
    """First encounters against recurrences of layouts: imports, mean rows, upper median durations."""
    order = Window.partitionBy("fingerprint").orderBy("day", "import_id")
    marked = imports.withColumn("first_time", F.row_number().over(order) == 1)
    return marked.groupBy("first_time").agg(F.count("*").alias("imports"), F.round(F.avg("rows"), 4).alias("mean_rows"), money.upper_median(F.collect_list("duration")).alias("median"))


def failures(imports: DataFrame) -> DataFrame:
    """Failures by code with the layout that has most of them; ties by fingerprint."""
    pairs = imports.groupBy("code", "fingerprint").agg(F.count("*").alias("n"))
    return pairs.groupBy("code").agg(F.sum("n").alias("failures"), F.min_by("fingerprint", F.struct(-F.col("n"), "fingerprint")).alias("dominant"))


def recent_summary(imports: DataFrame, last: int) -> DataFrame:
    """Histogram of banks over the last imports."""
    return imports.orderBy(F.desc("import_id")).limit(last).groupBy("bank").agg(F.count("*").alias("imports"), F.sum("rows").alias("rows"))


def analysis_summary(sessions: DataFrame, last: int) -> DataFrame:
    """Counters of statement analyses as rows of (part, key, n): all of them, and of the ``last`` newest with the merged histogram of their reasons.

    ``sessions``: session_id, at, outcome, layout, rows and reasons, a JSON object of counts. ALL: sessions, PARSED, FAILED and layouts (distinct, not null).
    RECENT: sessions, rows, unanchored (all counts) and unreadable, the sessions whose reasons are no object of whole numbers; these add nothing. REASON: each
    reason's count; reading it by count, highest first, then by name, gives the report's order.
    """
    newest = sessions.orderBy(F.desc("at"), F.desc("session_id")).limit(last)
    read = newest.withColumn("blank", F.trim(F.coalesce("reasons", F.lit(""))) == "").withColumn("map", F.from_json("reasons", "map<string,string>"))
    whole = F.forall(F.map_values("map"), lambda v: F.coalesce(v.rlike(r"^-?\d{1,9}$"), F.lit(False)))
    read = read.withColumn("good", F.coalesce(F.col("map").isNotNull() & whole, F.lit(False)) & ~F.col("blank"))
    counts = read.where("good").select(F.explode("map").alias("key", "n")).groupBy("key").agg(F.sum(F.col("n").cast("long")).alias("n"))
    stack = lambda part, **n: F.inline(F.array(*[F.struct(F.lit(part).alias("part"), F.lit(k).alias("key"), F.coalesce(v, F.lit(0)).cast("long").alias("n")) for k, v in n.items()]))
    ever = sessions.agg(F.count("*").alias("a"), F.count(F.when(F.col("outcome") == "PARSED", 1)).alias("p"), F.count(F.when(F.col("outcome") == "FAILED", 1)).alias("f"), F.count_distinct("layout").alias("l"))
    now = read.agg(F.count("*").alias("a"), F.sum("rows").alias("r"), F.sum(F.when(F.col("good"), F.aggregate(F.map_values("map"), F.lit(0).cast("long"), lambda x, v: x + v.cast("long")))).alias("u"), F.count(F.when(~F.col("good") & ~F.col("blank"), 1)).alias("x"))
    every = ever.select(stack("ALL", sessions=F.col("a"), PARSED=F.col("p"), FAILED=F.col("f"), layouts=F.col("l")))
    recent = now.select(stack("RECENT", sessions=F.col("a"), rows=F.col("r"), unanchored=F.col("u"), unreadable=F.col("x")))
    return every.union(recent).union(counts.select(F.lit("REASON"), "key", "n"))


def changed_headers(imports: DataFrame) -> DataFrame:
    """Whether an import's layout differs from the one before of its bank; the first doesn't."""
    order = Window.partitionBy("bank").orderBy("day", "import_id")
    return imports.select("import_id", F.coalesce(F.col("fingerprint") != F.lag("fingerprint").over(order), F.lit(False)).alias("changed"))


def merge_registry(registry: DataFrame, found: DataFrame) -> DataFrame:
    """An upsert: least first day, greatest last day, added counts, the registered name kept."""
    both = registry.select("fingerprint", "name", "first_day", "last_day", "uses").unionByName(found.select("fingerprint", F.lit(None).cast("string").alias("name"), "first_day", "last_day", "uses"))
    return both.groupBy("fingerprint").agg(F.max("name").alias("name"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("uses").alias("uses"))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert that overwrites rows with the same keys."""
    both = old.withColumn("newer", F.lit(0)).unionByName(new.withColumn("newer", F.lit(1)))
    return both.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("newer")))).where("r = 1").drop("r", "newer")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the new rows whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
