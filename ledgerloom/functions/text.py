"""Text functions of the ledger: normalisation, merchants, keywords, masking, similarity."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in a description that name a payment rail and no merchant.
RAIL_TOKENS = [
    "upi", "neft", "imps", "rtgs", "ach", "nach", "ecs", "eft", "clg", "byclg",
    "atm", "pos", "chq", "cheque", "inb", "tpt", "ift", "mmt", "vps", "wdl",
    "payment", "transfer", "withdrawal", "purchase", "txn", "trf", "ref",
]
# Category keywords, in order of precedence.
CATEGORY_KEYWORDS = [
    ("Salary", ["salary", "payroll", "income tax refund", "stipend"]),
    ("Rent", ["house rent", "rent paid", "rent payment", "monthly rent", "rent due", "landlord", "housing society", "maintenance chg"]),
    ("Groceries", ["bigbasket", "blinkit", "zepto", "grofers", "dmart", "grocery", "supermarket"]),
    ("Dining", ["swiggy", "zomato", "restaurant", "cafe", "starbucks", "dominos", "mcdonald", "kfc"]),
    ("Transport", ["uber", "ola", "rapido", "irctc", "petrol", "fuel", "metro", "fastag", "parking"]),
    ("Utilities", ["electricity", "power bill", "water bill", "gas bill", "broadband", "airtel", "jio", "recharge"]),
    ("Shopping", ["amazon", "flipkart", "myntra", "ajio", "nykaa", "decathlon"]),
    ("Health", ["pharmacy", "apollo", "medplus", "hospital", "clinic", "netmeds", "1mg"]),
    ("Entertainment", ["netflix", "prime video", "hotstar", "spotify", "bookmyshow", "pvr", "inox"]),
    ("Investments", ["mutual fund", "sip", "zerodha", "groww", "upstox", "nps", "ppf", "demat"]),
    ("Fees/Interest", ["annual fee", "late fee", "finance charge", "interest charged", "penalty"]),
    ("Transfer", ["credit card payment", "card bill payment", "autopay", "neft to", "imps to", "billdesk"]),
    ("Loan EMI", ["loan emi", "emi payment", "emi deduction", "personal loan", "home loan", "car loan", "auto loan"]),
    ("Insurance", ["insurance", "lic premium", "policybazaar", "premium payment"]),
    ("Cash Withdrawal", ["atm withdrawal", "atm wdl", "cash withdrawal", "cash wdl"]),
    ("Travel", ["makemytrip", "goibibo", "yatra", "airbnb", "oyo", "indigo", "spicejet", "vistara", "hotel booking"]),
    ("Subscriptions", ["google one", "icloud", "adobe", "microsoft 365", "linkedin premium"]),
    ("Education", ["udemy", "coursera", "byjus", "tuition fee", "school fee", "college fee"]),
    ("Gifts & Donations", ["donation", "charity", "ngo donation", "gift"]),
]
# Words that mark a refund.
REFUND_WORDS = ["refund", "reversal", "returned", "chargeback", "credit adjustment", "cancelled", "canceled"]


#: Tokens that are looked at first: a long text's merchant stands in front, its other tokens are read only where these don't settle it.
HEAD = 16


def once(c: Column, f) -> Column:
    """f(c) with ``c`` worked out once: a lambda's variable is a value, whereas a Column named twice is computed twice, and optimizers may copy it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalize(c: Column) -> Column:
    """Lower case, other characters than a-z, 0-9 to single spaces, trimmed; null becomes empty."""
    # one pass; a class with a space in it takes three times as long
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def _tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def _first_tokens(norm: Column) -> Column:
    return F.filter(F.slice(F.split(norm, " ", HEAD + 1), 1, HEAD), lambda t: t != "")


def tokens(c: Column) -> Column:
    return _tokens(normalize(c))


def extract_merchant(c: Column) -> Column:
    """Of the first four tokens that are no reference code, those longer than one character.

    A code is letters, four digits or more, letters. Without such a token the rest as it is, or unknown.
    """
    return once(normalize(c), merchant_of)


def merchant_of(norm: Column) -> Column:
    """``extract_merchant`` of a text that is normalised already."""
    plain = lambda ts: F.filter(ts, lambda t: ~t.rlike("^[a-z]*[0-9]{4,}[a-z]*$"))
    named = lambda rest: F.nullif(F.array_join(F.filter(F.slice(rest, 1, 4), lambda t: F.length(t) > 1), " "), F.lit(""))
    # fewer than four tokens in front settle nothing: the fourth may come later
    front = once(plain(_first_tokens(norm)), lambda rest: F.when(F.size(rest) >= 4, named(rest)))
    whole = once(plain(_tokens(norm)), lambda rest: F.coalesce(named(rest), F.when(F.size(rest) > 0, F.array_join(rest, " ")), F.lit("unknown")))
    return F.coalesce(front, whole)


def significant_token(c: Column) -> Column:
    """First token of over two characters that names no rail, else the first that names none; null if all do."""
    return once(normalize(c), token_of)


def token_of(norm: Column) -> Column:
    """``significant_token`` of a text that is normalised already."""
    named = lambda ts: F.filter(ts, lambda t: ~t.isin(RAIL_TOKENS))
    long = lambda ts: F.get(F.filter(ts, lambda t: F.length(t) > 2), F.lit(0))
    return F.coalesce(once(named(_first_tokens(norm)), long), once(named(_tokens(norm)), lambda ts: F.coalesce(long(ts), F.get(ts, F.lit(0)))))


def display_name(c: Column) -> Column:
    """Every word with its first letter in upper case and its tail as it is."""
    words = F.transform(F.split(F.trim(c), " +"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("Unknown Merchant")).otherwise(F.array_join(words, " "))


def _keywords() -> str:
    """A pattern of all keywords behind a space, by their first letters: one pass over a text finds what stands in it.

    Matches are empty, so keywords may overlap; of two that begin at one word the longer is found.
    """
    words = sorted({w for _, ws in CATEGORY_KEYWORDS for w in ws}, key=lambda w: (w[0], -len(w), w))
    letters = [f"{k}(?:{'|'.join(w[1:] for w in group)})" for k, group in groupby(words, key=lambda w: w[0])]
    return f" (?=({'|'.join(letters)})(?: |$))"


_KEYWORDS = _keywords()


def keyword_category(c: Column) -> Column:
    """The first category one of whose keywords stands in the text as whole words, else Other."""
    return once(normalize(c), category_of)


def category_of(norm: Column) -> Column:
    """``keyword_category`` of a text that is normalised already."""

    def first(found: Column) -> Column:
        out = F.lit("Other")
        for name, words in reversed(CATEGORY_KEYWORDS):
            # a longer keyword that begins with one of these holds it, too
            held = sorted({w for _, ws in CATEGORY_KEYWORDS for w in ws if any(f"{w} ".startswith(f"{k} ") for k in words)})
            out = F.when(F.arrays_overlap(found, F.array(*map(F.lit, held))), F.lit(name)).otherwise(out)
        return F.when(F.size(found) == 0, F.lit("Other")).otherwise(out)

    return once(F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), norm), F.lit(_KEYWORDS), F.lit(1))), first)


def is_salary(norm: Column) -> Column:
    """Whether the category of a normalised text is Salary: its keywords come first, so no other category's are looked at."""
    return norm.rlike(r"\b(?:" + "|".join(CATEGORY_KEYWORDS[0][1]) + r")\b")


def mentions_refund(c: Column) -> Column:
    return once(normalize(c), refund_in)


def refund_in(norm: Column) -> Column:
    """``mentions_refund`` of a text that is normalised already."""
    return reduce(or_, (F.contains(norm, F.lit(w)) for w in REFUND_WORDS))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if there are none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / every)


def mask_account(c: Column) -> Column:
    return F.when(F.length(F.regexp_replace(c, "[^0-9]", "")) > 0, F.concat(F.lit("****"), F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(4))))


def mask_email(c: Column) -> Column:
    """First character and domain; blank is null."""
    at = F.instr(c, "@")
    return F.when(F.trim(c) == "", None).when(at > 1, F.concat(F.substring(c, 1, 1), F.lit("***"), c.substr(at, F.length(c)))).otherwise(F.lit("***"))


def mask_phone(c: Column) -> Column:
    """An optional + and the last three digits; blank is null."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.trim(c) == "", None).otherwise(F.concat(F.when(c.startswith("+"), F.lit("+")).otherwise(F.lit("")), F.lit("*****"), F.right(digits, F.lit(3))))


def brand_of_domain(c: Column) -> Column:
    return F.lower(F.substring_index(c, ".", 1))


def identity_key(institution: Column, number: Column) -> Column:
    """SHA-256 of institution:digits, for numbers of four digits or more."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.sha2(F.concat_ws(":", institution, digits), 256))
