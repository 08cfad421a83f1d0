"""Who issued a statement, what product it shows, and the labelled fields of its first page."""

from datetime import date

from ledgerloom.operators import institutions, products
from ledgerloom.sources import labels, tables

RUNS = "doc_id long, page int, x double, y double, width double, text string"


def fields(spark, runs):
    rows = [(1, 0, float(x), float(y), 5.0 * len(t), t) for x, y, t in runs]
    found = labels.fields(tables.physical_rows(spark.createDataFrame(rows, RUNS))).collect()
    return found[0].asDict() if found else None


def test_values_beside_under_and_before_their_labels(spark):
    got = fields(spark, [(40, 10, "Account Holder : Ann Lee"), (40, 30, "Branch Name"), (200, 30, "Hill Road"), (40, 50, "IFSC Code"), (200, 50, "Credit Limit"), (45, 64, "abcd0123456"), (210, 64, "Rs. 1,000.50"), (40, 90, "XXXX XXXX 4321"), (300, 90, "Account Number"), (40, 110, "Statement Period"), (200, 110, "01/02/2024 to 29-02-2024"), (40, 130, "Due Date"), (40, 144, "see overleaf"), (45, 158, "15/03/2024")])
    assert (got["holder"], got["branch"], got["ifsc"], float(got["credit_limit"]), got["last4"]) == ("Ann Lee", "Hill Road", "ABCD0123456", 1000.5, "4321")
    assert (got["period_from"], got["period_to"], got["due_date"], got["opening"]) == (date(2024, 2, 1), date(2024, 2, 29), date(2024, 3, 15), None)


def test_labels_are_no_values_and_the_first_fitting_value_counts(spark):
    got = fields(spark, [(40, 10, "Account Name"), (300, 10, "Account Number"), (40, 24, "Ann Lee"), (300, 24, "99 8877"), (40, 60, "Account Name: Bob")])
    # an inline value comes before one below, wherever it stands
    assert (got["holder"], got["last4"]) == ("Bob", "8877")
    assert fields(spark, [(40, 10, "Name"), (40, 24, "12345")]) is None


def detected(spark, name, *lines):
    files = spark.createDataFrame([("f", name)], "file string, name string")
    texts = spark.createDataFrame([("f", t) for t in lines], "file string, text string")
    aliases = spark.createDataFrame([("A", "Alpha Bank"), ("A", "AB"), ("B", "Beta Bank of Alpha"), ("B", "Beta"), ("C", "Gamma")], "institution string, alias string")
    codes = spark.createDataFrame([("A", "ALPH"), ("B", "BETA")], "institution string, prefix string")
    return tuple(institutions.detect(files, texts, aliases, codes).first())[1:]


def test_signals_in_order(spark):
    assert detected(spark, "gamma.pdf", "IFSC: ALPH0123456", "Beta", "Beta news") == ("A", "LABELLED_CODE")
    # contradicting labels say nothing; then texts, the longest alias of each line
    assert detected(spark, "gamma.pdf", "IFSC: ALPH0123456", "IFSC BETA0123456", "a line of beta bank-of alpha bank") == ("B", "TEXT")
    assert detected(spark, "gamma.pdf", "alpha bank", "beta", "pay BETA0123456") == ("B", "CODE")
    assert detected(spark, "my gamma_1.pdf", "alpha bank", "beta") == ("C", "FILE_NAME")
    # whole words only, ties and unknown codes
    assert detected(spark, "gammas.pdf", "cabs", "XXXX0123456", None) == ("OTHER", "NONE")
    assert detected(spark, "alphabank beta", "al-pha ban k") == ("A", "TEXT")


def test_products_by_bits(spark):
    def one(*facts):
        rows = [(1, *f, None) if len(f) == 2 else (1, *f) for f in facts]
        r = products.classify(spark.createDataFrame([*rows, (None, "ROW_DATA", "EMI_FIELD", None)], "doc_id long, place string, signal string, named string")).first()
        return r["product"], r["score"], r["verdict"]

    head = lambda *names: [("COLUMN_HEADERS", n) for n in names]
    savings = head("DATE_COLUMN", "DESCRIPTION_COLUMN", "DEBIT_CREDIT_COLUMNS", "RUNNING_BALANCE_COLUMN", "TRANSACTION_ROWS", "OPENING_BALANCE_FIELD", "CLOSING_BALANCE_FIELD")
    assert one(*savings) == ("SAVINGS", 0.95, "VALIDATED")
    assert one(*savings, ("SECTION_TEXT", "EMI_FIELD")) == ("UNKNOWN", 0.0, "UNIDENTIFIED")
    assert one(*savings, ("DOCUMENT_TEXT", "EMI_FIELD"))[0] == "SAVINGS"
    assert one(*savings[:5])[0::2] == ("SAVINGS", "UNPROVEN")
    # as good as savings by score, and named
    assert one(*savings[:5], ("SECTION_TEXT", "PRODUCT_NAME", "CURRENT")) == ("CURRENT", 0.95, "VALIDATED")
    assert one(("SECTION_TEXT", "PRODUCT_NAME", "PPF")) == ("PPF", 0.6, "UNPROVEN")
    assert one(("DOCUMENT_TEXT", "PRODUCT_NAME", "PPF"))[0] == "UNKNOWN"
    assert one(*head("OUTSTANDING_FIELD", "EMI_FIELD"), *head("TENURE_FIELD"), ("DOCUMENT_TEXT", "EMI_FIELD")) == ("LOAN", 0.75, "VALIDATED")
    assert one(*head("EMI_FIELD"), ("NOWHERE", "OUTSTANDING_FIELD"), ("ROW_DATA", "odd"))[0] == "UNKNOWN"
