"""Which institution a file comes from, by four signals in a fixed order.

An alias stands for whole words: a text's runs of neighbouring words, written together, are joined with the aliases by equality, so a
registry of any size costs one hash join, and no text is scanned once for each alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE = r"\b([A-Z]{4})0[A-Z0-9]{6}\b"
UNKNOWN = "OTHER"


def squash(text: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def _matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """file, line and institution of every alias of the greatest length among those that a line holds as whole words.

    ``texts`` has file, line and text, ``aliases`` institution and alias.
    """
    known = aliases.select("institution", squash(F.col("alias")).alias("alias")).where("alias != ''").distinct()
    longest = known.agg(F.max(F.length("alias"))).head()[0] or 0
    words = F.filter(F.split(F.upper("text"), "[^A-Z0-9]+"), lambda w: w != "")
    placed = texts.select("file", "line", words.alias("words")).select("file", "line", "words", F.posexplode("words").alias("at", "first")).where(F.length("first") <= longest)
    # runs of words from here on, as long as an alias may be
    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("words") - F.col("at"), F.lit(max(longest, 1)))), lambda n: F.array_join(F.slice("words", F.col("at") + 1, n), ""))
    spelled = placed.select("file", "line", F.explode(F.filter(runs, lambda r: F.length(r) <= longest)).alias("alias")).distinct()
    found = spelled.join(known, "alias")
    best = F.max(F.length("alias")).over(Window.partitionBy("file", "line"))
    return found.withColumn("best", best).where(F.length("alias") == F.col("best")).select("file", "line", "institution").distinct()


def detect(files: DataFrame, lines: DataFrame, aliases: DataFrame, codes: DataFrame) -> DataFrame:
    """file, institution and the signal that named it, of every file.

    ``files`` has file and name, ``lines`` file and text; ``aliases`` institution and alias, ``codes`` institution and
    prefix (four letters of a branch code). In this order: the one institution of all known codes on lines that say IFSC; the one named on
    the most distinct lines (each line speaks for its longest aliases); the one of all known codes; the only one
    in the file's name. Contradiction and ties leave a signal without an answer; without any it is OTHER.
    """
    texts = lines.where("file is not null and text is not null").select("file", "text").distinct().withColumn("line", F.col("text"))
    prefixes = codes.select("institution", F.upper("prefix").alias("prefix")).distinct()
    printed = texts.select("file", F.upper("text").contains("IFSC").alias("labelled"), F.explode(F.regexp_extract_all("text", F.lit(CODE), F.lit(1))).alias("prefix"))
    coded = printed.join(prefixes, "prefix").groupBy("file").agg(
        *[F.when(F.min(F.when(c, F.col("institution"))) == F.max(F.when(c, F.col("institution"))), F.min(F.when(c, F.col("institution")))).alias(n) for n, c in (("by_label", F.col("labelled")), ("by_code", F.lit(True)))]
    )
    votes = _matches(texts, aliases).groupBy("file", "institution").agg(F.count("*").alias("n"))
    top = votes.groupBy("file").agg(F.max("n").alias("n"))
    named = votes.join(top, ["file", "n"]).groupBy("file").agg(F.min("institution").alias("by_text"), F.count("*").alias("ties")).where("ties = 1")
    called = _matches(files.where("file is not null and name is not null").select("file", F.lit("").alias("line"), F.col("name").alias("text")), aliases)
    called = called.groupBy("file").agg(F.min("institution").alias("by_name"), F.count("*").alias("ties")).where("ties = 1")
    every = files.where("file is not null").select("file").distinct()
    joined = every.join(coded, "file", "left").join(named.drop("ties"), "file", "left").join(called.drop("ties"), "file", "left")
    signal = F.when(F.col("by_label").isNotNull(), "LABELLED_CODE").when(F.col("by_text").isNotNull(), "TEXT").when(F.col("by_code").isNotNull(), "CODE").when(F.col("by_name").isNotNull(), "FILE_NAME").otherwise("NONE")
    return joined.select("file", F.coalesce("by_label", "by_text", "by_code", "by_name", F.lit(UNKNOWN)).alias("institution"), signal.alias("signal"))
