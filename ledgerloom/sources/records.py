"""CSV records of files of any size: a line break inside quotes belongs to its record, wherever the file is split.

Whether a line starts inside quotes is the parity of all quotes before it in its file. Each block of lines counts its quotes by itself;
the blocks' sums, a row a block, give every block what comes before it. So a file is read by as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELD = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
WHOLE = rf"(?s)^{_FIELD}(?:,{_FIELD})*+$"
#: Each field with the comma in front of it; a comma in front of the record gives the first one its own.
FIELD = rf"(?s),({_FIELD})"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at and line of text files; a block is what one task reads of a file, at grows within it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.withColumn("at", F.monotonically_increasing_id())


def records(lines: DataFrame) -> DataFrame:
    """file, record (from 0), first_line (from 0), cells and status of every record of the files' lines (file, block, at, line).

    status: OK; UNTERMINATED, the file's last record if a quote is still open at its end; MALFORMED, a quote inside a plain field or text behind a
    closing one. The latter two have no cells. Blank lines outside of quotes are no records; lines of a record are joined by \\n.
    Rows without a file or line are left out. ``block`` and ``at`` order a file's lines.
    """
    rows = lines.where("file is not null and line is not null").withColumn("quotes", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).cast("long"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    blank = F.trim("line") == ""
    rows = rows.withColumn("odd", before).withColumn("n", F.row_number().over(inside) - 1)
    # a line starts a record if the quotes before it are even; which ones are, in a block, depends on what comes before the block.
    # both ways are counted at once, so that no line is sorted again when that is known
    starts = lambda parity: ((F.col("odd") == parity) & ~blank).cast("long")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("blank", blank).withColumn("upto_even", F.sum(starts(0)).over(upto)).withColumn("upto_odd", F.sum(starts(1)).over(upto))
    blocks = rows.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum(starts(0)).alias("if_even"), F.sum(starts(1)).alias("if_odd"), F.count("*").alias("lines"))
    file = Window.partitionBy("file").orderBy("block")
    earlier, all_of = file.rowsBetween(Window.unboundedPreceding, -1), file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.withColumn("carry", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).withColumn("own", F.when(F.col("carry") == 0, F.col("if_even")).otherwise(F.col("if_odd")))
    blocks = blocks.withColumn("records_before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).withColumn("lines_before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    # the number of the record that a file leaves open, if it does
    blocks = blocks.withColumn("open", F.when(F.sum("quotes").over(all_of) % 2 == 1, F.sum("own").over(all_of) - 1))
    placed = rows.join(blocks.select("file", "block", "carry", "records_before", "lines_before", "open"), ["file", "block"])
    number = F.col("records_before") + F.when(F.col("carry") == 0, F.col("upto_even")).otherwise(F.col("upto_odd")) - 1
    placed = placed.where(((F.col("odd") + F.col("carry")) % 2 == 1) | ~F.col("blank")).select("file", number.alias("record"), (F.col("lines_before") + F.col("n")).alias("n"), "line", "open")
    whole = placed.groupBy("file", "record").agg(F.min("n").alias("first_line"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text"), F.max("open").alias("open"))
    status = F.when(F.col("record") == F.col("open"), "UNTERMINATED").when(~F.col("text").rlike(WHOLE), "MALFORMED").otherwise("OK")
    cells = F.expr("transform(regexp_extract_all(concat(',', text), '" + FIELD.replace("\\", "\\\\") + "', 1), c -> if(startswith(c, '\"'), replace(substr(c, 2, length(c) - 2), '\"\"', '\"'), c))")
    return whole.withColumn("status", status).select("file", "record", "first_line", F.when(F.col("status") == "OK", cells).alias("cells"), "status")
