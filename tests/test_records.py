"""CSV records: quoted line breaks, files split among tasks, and named bad rows."""

import random

from pyspark.sql import functions as F

from ledgerloom.sources import records


def split(spark, text, size=3):
    lines = [("f", k // size, k, x) for k, x in enumerate(text.split("\n"))]
    found = records.records(spark.createDataFrame([*lines, (None, 0, 0, "x"), ("f", 0, 0, None)], "file string, block long, at long, line string")).orderBy("record").collect()
    return [(r["first_line"], r["cells"], r["status"]) for r in found]


def test_quotes_commas_and_breaks(spark):
    text = 'a,"b\n\nc",d\n\n"say ""x"", y",\n"",z\nbad "q",1\n"a"b,2\n"open\nnever closed'
    assert split(spark, text) == [(0, ["a", "b\n\nc", "d"], "OK"), (4, ['say "x", y', ""], "OK"), (5, ["", "z"], "OK"), (6, None, "MALFORMED"), (7, None, "MALFORMED"), (8, None, "UNTERMINATED")]
    assert split(spark, "") == []


def test_blocks_change_nothing(spark):
    import csv
    import io

    rng = random.Random(2)
    rows = [["".join(rng.choice('ab ,"\n') for _ in range(rng.randint(0, 12))) + "x" for _ in range(3)] for _ in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    text = out.getvalue()
    for size in (1, 4, 1000):
        assert [c for _, c, _ in split(spark, text, size)] == rows


def test_a_file_split_inside_quotes(spark, tmp_path):
    body = "".join(f'{k},"{"line" * 5}\nnext ""{k}""\n",end\n' for k in range(400))
    (tmp_path / "a.csv").write_text(body)
    (tmp_path / "b.csv").write_text('1,"x\n2,y\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = records.read_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 5
        found = records.records(lines).orderBy("file", "record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [r["cells"] for r in found[:-1]] == [[str(k), f'{"line" * 5}\nnext "{k}"\n', "end"] for k in range(400)]
    assert found[-1]["status"] == "UNTERMINATED" and found[-1]["file"].endswith("b.csv")


def test_lines_are_dealt_by_block_and_by_record_only(spark):
    lines = spark.range(8).select(F.lit("f").alias("file"), (F.col("id") / 3).cast("long").alias("block"), F.col("id").alias("at"), F.lit('a,"b').alias("line"))
    found = records.records(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # one join, of the blocks' sums; no second one for a file's last record
    assert plan.count("Join ") == 1
    assert [(r["record"], r["status"]) for r in found.orderBy("record").collect()] == [(k, "MALFORMED") for k in range(4)]
