"""Personal data: base spans against Python's own matching of the contract's patterns; what the model adds and leaves alone."""

import hashlib
import random
import re

from ledgerloom.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KIND = "doc_id long, text string"


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in match.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + c for c in "0123456789" if luhn(head + c))


def check_base(rows, found):
    assert len(rows) == len(found)
    texts = dict(rows)
    for r in found:
        spans = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert tuple(r)[1:5] == tuple(sum(k == x for x, _, _ in spans) for k in PATTERNS), r
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r
        assert {x for x in joined.split(",") if x} <= set(r["spans"].split(",")), r


def test_base_spans_of_random_and_odd_texts(spark):
    rng = random.Random(11)
    parts = ["1", "12", "255", "256", ".", "..", "-", " ", "  ", "+", "+1", "(", ")", "a", "é", "@", "a@b.c", "_d@e.f.g", "\n", "4111111111111111", "👍", "00", "%", "x.y@z-z.com.", "300.1.1.1", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for k in range(400)]
    long = [None, "", " ".join(["12"] * 30_000), "1" * 50_000, "a@" + ".b" * 20_000, "+" + "1 " * 30_000 + "1", "a" * 200_000 + "@x.org", "1.2.3.4 " * 3_000, "é" * 99 + card(rng)]
    rows += [(1000 + k, x) for k, x in enumerate(long)]
    check_base(rows, pii.detect(spark.createDataFrame(rows, KIND)).collect())


def test_swallowed_spans_are_added_and_clean_numbers_left_alone(spark):
    rng = random.Random(12)
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    bad = lambda: "".join(rng.choice("0123456789") for _ in range(16))
    rows = [(k, f"call {phone()} or write m.{k}@mail.org from 10.{k % 256}.2.{k % 200} pay {card(rng)} number {next(x for x in iter(bad, 0) if not luhn(x))} part 300.{k}.2.1 end") for k in range(300)]
    number = card(rng)
    rows.append((1000, f"swallowed {phone()} {number} end"))
    clean = "On 2024-01-05 at 12:30 version 3.11.2 of 1,200 parts, 1234 5678 in all, look at example dot com"
    rows.append((1001, clean))
    found = pii.detect(spark.createDataFrame(rows, KIND)).collect()
    check_base(rows, found)
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert base(dict(rows)[1000]) == []
    assert spans[1000] == f"card:{len('swallowed +1 (555) 555-0000 ')}:{len('swallowed +1 (555) 555-0000 ') + 16},phone:10:27"
    assert spans[1001] == ""
    assert all(spans[k] == ",".join(f"{a}:{b}:{c}" for a, b, c in base(t)) for k, t in rows if k < 1000)


def test_no_examples_nulls_repeated_rows_and_other_columns(spark):
    rows = [(None, "a@b.org", 1), (5, "a@b.org", 2), (5, "a@b.org", 3), (6, None, 4)]
    found = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pii.detect(spark.createDataFrame(rows, KIND + ", base long")).collect())
    assert found == [("5", 1, "email:0:7"), ("5", 1, "email:0:7"), ("6", 0, ""), ("None", 1, "email:0:7")]
    assert pii.detect(spark.createDataFrame([], KIND)).collect() == []
