"""Statement files: CSV rows to staged, set-aside and rejected ledger rows, and receipts from HTML.

A file is a set of text lines with ordinals; header detection, synonyms, dates and
amounts are Column expressions over all files at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import once

# Header names by role, in order of preference.
HINTS = {
    "date": ["transaction date", "txn date", "value date", "posting date", "date"],
    "description": ["narration", "description", "particulars", "details", "remarks"],
    "debit": ["withdrawal amt", "withdrawal", "debit amount", "debit"],
    "credit": ["deposit amt", "deposit", "credit amount", "credit"],
    "amount": ["transaction amount", "amount"],
    "type": ["type", "dr/cr", "transaction type"],
    "reference": ["reference", "ref no", "chq/ref no", "utr"],
    "balance": ["closing balance", "balance", "available balance"],
    "category": ["category"],
}
#: Day-first formats come before the month-first one.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd-MM-yy", "dd MMM yyyy", "dd-MMM-yyyy", "dd-MMM-yy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy"]
#: Few rows name a date at all; only those are looked at cell by cell for a header.
DATED = "|".join(HINTS["date"])
MARKERS = ["opening balance", "closing balance", "balance forward", "balance b/f", "balance c/f"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and cells of CSV files; the order within a file is kept, quotes and commas are parsed natively."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return split_lines(raw)


def split_lines(files: DataFrame) -> DataFrame:
    """file, line_no and cells from (file, value) with a file's whole text in a row."""
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return lines.select("file", "line_no", _cells(F.col("line")).alias("cells"))


def _cells(line: Column) -> Column:
    bare = lambda c: F.when(c.contains('"'), F.regexp_replace(F.regexp_replace(c, '^"(.*)"$', "$1"), '""', '"')).otherwise(c)
    return F.transform(F.regexp_extract_all(line, F.lit(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'), F.lit(0)), lambda c: once(F.when(c.startswith(","), c.substr(F.lit(2), F.length(c))).otherwise(c), bare))


def clean_header(c: Column) -> Column:
    """Lower case, without a unit in brackets or punctuation at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s*\([^)]*\)$", ""), r"[.:*]+$", ""))


def _hinted(cells: Column, roles: list[str]) -> Column:
    names = [h for r in roles for h in HINTS[r]]
    return F.exists(cells, lambda c: clean_header(c).isin(names))


def _is_header(cells: Column) -> Column:
    return (F.size(cells) >= 2) & _hinted(cells, ["date"]) & _hinted(cells, ["amount", "debit", "credit"])


def header_rows(lines: DataFrame) -> DataFrame:
    """Each file's first row of two or more cells with a date and an amount name; line -1 if there is none."""
    dated = F.exists("cells", lambda c: F.lower(c).rlike(DATED))
    hit = dated & _is_header(F.col("cells"))
    found = lines.groupBy("file").agg(F.min(F.when(hit, F.struct("line_no", F.transform("cells", clean_header).alias("names")))).alias("h"))
    return found.select("file", F.coalesce("h.line_no", F.lit(-1)).alias("header_line"), F.col("h.names").alias("names"))


def zip_rows(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header as maps by name; of equal names the last non-blank value counts, missing cells are null."""
    rows = lines.join(_placed(headers.where("header_line >= 0")), "file").where(F.col("line_no") > F.col("header_line"))
    return rows.select("file", "line_no", _by_name(F.col("cells")).alias("raw"))


def _placed(headers: DataFrame) -> DataFrame:
    """With the distinct names (keys) and where each one's values stand (places): found once a file."""
    return headers.withColumn("keys", F.array_distinct("names")).withColumn("places", _places(F.col("names")))


def _places(names: Column) -> Column:
    return F.transform(F.array_distinct(names), lambda n: F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.get(names, i) == n))


def _by_name(cells: Column) -> Column:
    def read(row: Column) -> Column:
        value = lambda i: F.nullif(F.trim(F.get(row, i)), F.lit(""))
        return F.transform("places", lambda at: F.aggregate(at, F.lit(None).cast("string"), lambda v, i: F.coalesce(value(i), v)))

    return F.map_from_arrays("keys", once(cells, read))


def file_rows(files: DataFrame) -> DataFrame:
    """What ``zip_rows`` gives for ``split_lines`` and ``header_rows`` of the files, in one pass: no line is read twice, shuffled or joined."""
    lines = files.where("file is not null").select("file", F.split("value", "\r?\n").alias("lines"))
    told = F.filter(F.transform("lines", lambda s, i: F.struct(i.alias("line_no"), s.alias("line"))), lambda r: (F.trim(r["line"]) != "") & F.lower(r["line"]).rlike(DATED))
    read = F.filter(F.transform(told, lambda r: F.struct(r["line_no"].alias("line_no"), _cells(r["line"]).alias("cells"))), lambda r: _is_header(r["cells"]))
    header = F.transform(F.slice(read, 1, 1), lambda r: once(F.transform(r["cells"], clean_header), lambda names: F.struct(r["line_no"].alias("at"), F.array_distinct(names).alias("keys"), _places(names).alias("places"))))
    # outer, and a condition that is never null: from others Spark infers conditions that would search the header once more
    rows = lines.withColumn("header", F.get(header, F.lit(0))).select("file", "header", F.posexplode_outer("lines").alias("line_no", "line"))
    rows = rows.where(F.coalesce((F.col("line_no") > F.col("header.at")) & (F.trim("line") != ""), F.lit(False)))
    return rows.select("file", "line_no", F.col("header.keys").alias("keys"), F.col("header.places").alias("places"), _cells(F.col("line")).alias("cells")).select("file", "line_no", _by_name(F.col("cells")).alias("raw"))


def first_of(raw: Column, role: str) -> Column:
    """The first non-blank value among a role's names."""
    return F.coalesce(*[F.try_element_at(raw, F.lit(h)) for h in HINTS[role]])


def parse_number(c: Column) -> Column:
    """DR and brackets are negative; currency signs, commas and spaces don't count; blank and - are null."""
    def read(text: Column) -> Column:
        negative = text.rlike(r"DR\.?$") | text.rlike(r"^\(.*\)$")
        digits = F.regexp_replace(text, r"RS\.?|INR|₹|[CD]R\.?$|[(),\s]", "")
        # a failed cast costs far more than a look: no number holds another letter than E
        value = once(digits, lambda t: F.when(t.rlike(r"^[^A-DF-Z]*\p{Nd}[^A-DF-Z]*$"), t.try_cast("decimal(14,2)")))
        return once(value, lambda v: F.when(v.isNotNull() & negative, -F.abs(v)).otherwise(v))

    return once(F.upper(F.trim(c)), read)


def first_amount(raw: Column, role: str) -> Column:
    """The first amount that isn't 0 among a role's names, else the first that parses."""
    values = F.array(*[parse_number(F.try_element_at(raw, F.lit(h))) for h in HINTS[role]])
    read = lambda vs: F.filter(vs, lambda v: v.isNotNull())
    return once(once(values, read), lambda vs: F.coalesce(F.get(F.filter(vs, lambda v: v != 0), F.lit(0)), F.get(vs, F.lit(0))))


def _shape(form: str) -> str:
    """A pattern that every text of a date format matches: a failed parse costs far more than a look at the text."""
    digits = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MM": r"\d{2}", "dd": r"\d{2}", "d": r"\d{1,2}", "MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]{3,}"}
    return "^" + re.sub("[A-Za-z]+|[.]", lambda m: digits.get(m[0], "[.]"), form) + "$"


def parse_date(c: Column) -> Column:
    """The first of the formats that reads the text, without times, ordinal suffixes or missing separators."""
    def plain(text: Column) -> Column:
        text = F.regexp_replace(text, r"[ T]\d{1,2}:\d{2}(:\d{2})?.*$", "")
        text = F.regexp_replace(F.regexp_replace(text, r"^(\d)(st|nd|rd|th)\b", "0$1"), r"^(\d{2})(st|nd|rd|th)\b", "$1")
        text = F.regexp_replace(text, r"^(\d{2})([A-Za-z]{3})(\d{4})$", "$1-$2-$3")
        return F.regexp_replace(text, r"^([A-Za-z]{3,9})\s*(\d{1,2})\s*,\s*(\d{4})$", "$1 $2, $3")

    def read(text: Column) -> Column:
        return F.coalesce(*[F.when(text.rlike(_shape(f)), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f in DATE_FORMATS])

    # no format has fewer than four digits, of which an ordinal's 0 may be added
    return once(F.trim(c), lambda t: F.when(t.rlike(r"\d\D*\d\D*\d"), once(plain(t), read)))


def raw_sign(c: Column) -> Column:
    """INCOME, EXPENSE or null from marks in the amount's text."""
    text = F.upper(F.trim(c))
    return F.when(text.rlike(r"CR\.?$"), "INCOME").when(text.rlike(r"DR\.?$"), "EXPENSE").when(text.startswith("+"), "INCOME")


def stage(rows: DataFrame) -> DataFrame:
    """Every row with its date, amount, direction, reference, balance and outcome.

    Direction: the type column, then a credit column, then marks in the amount, then EXPENSE.
    outcome is STAGED, MARKER (balances carried) or UNPARSEABLE, for which reason says why.
    """
    raw = F.col("raw")
    # one array's struct: a later filter by outcome can't be moved below it, where it would read every field again
    read = F.struct(
        parse_date(first_of(raw, "date")).alias("txn_date"), first_of(raw, "description").alias("description"), first_amount(raw, "debit").alias("debit"), first_amount(raw, "credit").alias("credit"),
        parse_number(first_of(raw, "amount")).alias("plain"), raw_sign(first_of(raw, "amount")).alias("sign"), F.lower(first_of(raw, "type")).alias("type"), first_of(raw, "reference").alias("reference"), parse_number(first_of(raw, "balance")).alias("balance"), first_of(raw, "category").alias("category"),
        F.array_join(F.array_sort(F.map_keys("raw")), "|").alias("columns"),
    )
    read = rows.select("file", "line_no", F.inline(F.array(read)))
    amount = F.abs(F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), F.when(F.col("credit") != 0, F.col("credit")), "plain", "debit", "credit"))
    named = F.when(F.col("type").isin("credit", "cr", "income", "c") | F.contains("type", F.lit("income")), "INCOME").when(F.col("type").isin("debit", "dr", "expense", "d"), "EXPENSE")
    by_column = F.when((F.col("credit") != 0) & F.coalesce(F.col("debit") == 0, F.lit(True)), "INCOME").when(F.col("debit") != 0, "EXPENSE")
    marker = F.lower(F.coalesce("description", F.lit(""))).rlike("|".join(MARKERS))
    done = read.withColumn("amount", amount).withColumn("txn_type", F.coalesce(named, by_column, "sign", F.lit("EXPENSE")))
    reason = F.when(F.col("txn_date").isNull(), "NO_DATE").when(F.col("amount").isNull(), "NO_AMOUNT").when(F.col("amount") == 0, "ZERO_AMOUNT")
    outcome = F.when(marker, "MARKER").when(reason.isNotNull(), "UNPARSEABLE").otherwise("STAGED")
    return done.select("file", "line_no", "txn_date", "description", "amount", "txn_type", "category", "reference", "balance", outcome.alias("outcome"), F.when(~marker, reason).alias("reason"), "columns")


def mark_duplicates(staged: DataFrame, ledger: DataFrame) -> DataFrame:
    """Staged rows with the number of ledger rows of the same date, amount and description."""
    known = ledger.groupBy("txn_date", "amount", "description").agg(F.count("*").alias("matches"))
    return staged.join(known, ["txn_date", "amount", "description"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def reject_summary(staged: DataFrame) -> DataFrame:
    """Unparseable rows by reason and by the file's columns."""
    return staged.where("outcome = 'UNPARSEABLE'").groupBy("reason", "columns").agg(F.count("*").alias("rows"))


def metadata(lines: DataFrame) -> DataFrame:
    """Holder, masked number, period and balances from the labelled lines of a file; the first of each counts."""
    text = F.array_join("cells", ",")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda p, name: F.first(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")), ignorenulls=True).over(order).alias(name)
    found = lines.select("file", first(r"(?i)(?:account holder|name)\s*[:,]\s*([^,]+)", "holder"), first(r"(?i)account (?:no|number)\.?\s*[:,]\s*[\dXx*]*(\d{4})", "last4"), first(r"(?i)ifsc\s*[:,]\s*([A-Za-z]{4}0\w{6})", "ifsc"), first(r"(?i)opening balance\s*[:,]\s*\"?([\d,.]+)", "opening"), first(r"(?i)closing balance\s*[:,]\s*\"?([\d,.]+)", "closing"))
    return found.distinct().withColumn("opening", parse_number(F.col("opening"))).withColumn("closing", parse_number(F.col("closing")))


#: Runs that one task buckets: the work's parts grow with the runs, not the parts' sizes.
PART_RUNS = 500_000


def bucket_cells(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each run's column: the nearest anchor of its page, the first of equals (anchors are a few rows a page).

    A run meets its page's anchors as an array, so it isn't copied for each. Runs are counted once for the number of parts.
    """
    parts = max(1, -(-runs.count() // PART_RUNS))
    page = ["doc_id", "page"]
    # a page's anchors are gathered where its runs are: neither side is dealt twice
    near = anchors.repartition(parts, *page).groupBy(*page).agg(F.collect_list(F.struct("anchor_x", "column")).alias("anchors"))
    met = runs.select(*page, "x", "y", "text").repartition(parts, *page).join(near, page)
    nearest = F.array_min(F.transform("anchors", lambda a: F.struct(F.abs(F.col("x") - a["anchor_x"]).alias("off"), a["column"].alias("column"))))
    return met.select(*page, "x", "y", "text", nearest["column"].alias("column")).distinct()


def receipts(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Receipt fields from HTML by templates: (template, marker, stop, amount_pattern, date_pattern).

    PARSED with amount and date, NOT_A_RECEIPT without the marker or with the stop word, MALFORMED else.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    rows = pages.select("page_id", plain.alias("plain")).join(F.broadcast(templates))
    amount = F.regexp_replace(F.expr("regexp_extract(plain, amount_pattern, 1)"), ",", "").try_cast("decimal(14,4)")
    date = F.expr("regexp_extract(plain, date_pattern, 1)")
    status = F.when(F.contains(F.lower("plain"), F.lower("stop")) | ~F.contains(F.lower("plain"), F.lower("marker")), "NOT_A_RECEIPT").when(F.col("amount").isNull() | F.col("day").isNull(), "MALFORMED").otherwise("PARSED")
    return rows.withColumn("amount", F.bround(amount, 2)).withColumn("day", parse_date(F.nullif(date, F.lit("")))).select("page_id", "template", status.alias("status"), F.when(status == "PARSED", F.col("amount")).alias("amount"), F.when(status == "PARSED", F.col("day")).alias("day"))
