"""Labelled fields of a statement's printed pages: a value is found by where it stands to its label.

Everything is a Column expression over ``tables.physical_rows``: words are joined to phrases within a row, a window brings the two
rows below, and each label proposes the value in its own phrase, to its right, below it or to its left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statements import once, parse_date, parse_number

#: Points between words of one phrase, and between the left edges of a label and a value below it.
PHRASE_GAP, BELOW = 6.0, 25.0
# Labels by field.
LABELS = {
    "holder": r"account holder(?: name)?|account name|customer name|name",
    "number": r"account (?:number|no\.?)|(?:primary )?(?:credit )?card (?:number|no\.?)",
    "branch": r"branch(?: name)?",
    "ifsc": r"ifsc(?: code)?",
    "period": r"statement period",
    "credit_limit": r"(?:total )?credit limit(?: \(including cash\))?",
    "due_date": r"(?:payment )?due date",
    "opening": r"opening balance",
    "closing": r"closing balance",
}
_ANY = "|".join(f"(?:{p})" for p in LABELS.values())
_DATE = r"\d{1,4}[-/. ][A-Za-z0-9]{2,9}[-/., ]+\d{2,4}"
SPAN = rf"({_DATE})\s*(?:to|-|–)\s*({_DATE})"
#: What a field's value looks like. Names and branches are texts that aren't labels.
SHAPES = {
    "holder": r"^[A-Za-z][A-Za-z .']*$",
    "number": r"^[\dXx*]{2,}(?:[\s-][\dXx*]{2,})*$",
    "branch": r"^[A-Za-z].*$",
    "ifsc": r"^[A-Za-z]{4}0[A-Za-z0-9]{6}$",
    "period": f"^{SPAN}$",
    "credit_limit": None,
    "due_date": None,
    "opening": None,
    "closing": None,
}


def phrases(rows: DataFrame) -> DataFrame:
    """doc_id, page, row_no and phrases: cells joined where at most ``PHRASE_GAP`` lies between them."""
    cells = F.zip_with(F.arrays_zip("x", "right"), "texts", lambda e, t: F.struct(e["x"].alias("x"), e["right"].alias("right"), t.alias("text")))
    last = "element_at(acc, -1)"
    joined = f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('x', {last}.x, 'right', c.right, 'text', concat({last}.text, ' ', c.text))))"
    fold = f"aggregate(cells, cast(array() as array<struct<x:double,right:double,text:string>>), (acc, c) -> if(size(acc) > 0 and c.x - {last}.right <= {PHRASE_GAP}, {joined}, concat(acc, array(c))))"
    return rows.select("doc_id", "page", "row_no", cells.alias("cells")).select("doc_id", "page", "row_no", F.expr(fold).alias("phrases"))


def _valid(field: str, value: Column) -> Column:
    """The value if it is one of the field's, else null."""
    def read(text: Column) -> Column:
        if SHAPES[field] is None:
            good = parse_date(text).isNotNull() if field == "due_date" else parse_number(text).isNotNull()
        else:
            good = text.rlike(SHAPES[field])
        return F.when(good & ~text.rlike(f"(?i)^(?:{_ANY})[\\s:]*$"), text)

    return once(F.trim(F.regexp_replace(value, r"^[\s:\-]+", "")), read)


def _number(value: Column) -> Column:
    """The last four digits, if it ends in four."""
    return F.nullif(F.regexp_extract(F.regexp_replace(value, r"[\s-]", ""), r"(\d{4})$", 1), F.lit(""))


def fields(rows: DataFrame) -> DataFrame:
    """doc_id, holder, last4, branch, ifsc, period_from, period_to, credit_limit, due_date, opening and closing of every document.

    A label's value is what follows it in its own phrase, else the nearest phrase to its right, the nearest one in the two rows below
    that starts at most ``BELOW`` points beside it or lies under it, or the nearest to its left; the first that has the field's shape
    counts, by that order, then by place. A field without one is null; a document without any has no row.
    """
    order = Window.partitionBy("doc_id").orderBy("row_no")
    near = lambda k: F.when(F.lead("page", k).over(order) == F.col("page"), F.lead("phrases", k).over(order))
    rows = phrases(rows).withColumn("below", F.concat(F.coalesce(near(1), F.array()), F.coalesce(near(2), F.array())))
    labelled = lambda p: p["text"].rlike(f"(?i)^(?:{_ANY})")
    each = rows.where(F.exists("phrases", labelled))

    def best(field: str, label: str) -> Column:
        """The row's first value of a field with its place: a row is read where it stands, so no copies of it are dealt again for each field."""
        pattern = f"(?i)^(?:{label})(?![A-Za-z])[\\s:.]*"

        def tried(p: Column, at: Column) -> Column:
            inline = F.regexp_replace(p["text"], pattern, "")
            bare = F.trim(inline) == ""
            beneath = F.filter("below", lambda q: (F.abs(q["x"] - p["x"]) <= BELOW) | ((q["x"] <= p["right"]) & (q["right"] >= p["x"])))
            said = lambda k, v: F.struct(F.lit(k).alias("rank"), F.col("row_no").alias("row_no"), at.alias("at"), v.alias("value"))
            left = F.when(at > 0, F.get("phrases", at - 1)["text"])
            open_ = F.array(said(1, F.get("phrases", at + 1)["text"]), said(2, F.get(beneath, F.lit(0))["text"]), said(3, F.get(beneath, F.lit(1))["text"]), said(4, left))
            return F.when(p["text"].rlike(pattern), F.when(bare, open_).otherwise(F.array(said(0, inline))))

        read = lambda v: _valid(field, v) if field != "number" else _number(_valid(field, v))
        tries = F.flatten(F.filter(F.transform("phrases", tried), lambda t: t.isNotNull()))
        known = F.transform(tries, lambda t: F.struct(t["rank"].alias("rank"), t["row_no"].alias("row_no"), t["at"].alias("at"), read(t["value"]).alias("value")))
        return F.array_min(F.filter(known, lambda t: t["value"].isNotNull()))

    per_row = each.select("doc_id", *[best(field, label).alias(field) for field, label in LABELS.items()])
    # rows come sorted by document from the window, so a document's fields are taken as they pass
    wide = per_row.groupBy("doc_id").agg(*[F.min(f)["value"].alias(f) for f in LABELS]).where(F.coalesce(*LABELS).isNotNull())
    span = lambda k: parse_date(F.nullif(F.regexp_extract("period", SPAN, k), F.lit("")))
    amount = lambda c: parse_number(F.col(c)).alias(c)
    return wide.select("doc_id", "holder", F.col("number").alias("last4"), "branch", F.upper("ifsc").alias("ifsc"), span(1).alias("period_from"), span(2).alias("period_to"), amount("credit_limit"), parse_date(F.col("due_date")).alias("due_date"), amount("opening"), amount("closing"))
