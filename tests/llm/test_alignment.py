"""Token alignment against whole texts encoded by the two libraries, with plain dictionaries."""

import collections
import hashlib
import os

import pytest

from ledgerloom.llm import alignment
from ledgerloom.llm.queries import BYTE_LEVEL, MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")
ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b\n\n c\n d e  f"), (5, "x▁y"), (6, "<|endoftext|> hi <|endoftext|>"), (7, "日本語 テキスト　です。é à\n\n\n\nü"), (8, "\t\ttab\r\nline's we'll 1234 56\n"), (9, "a" * 3000), (10, "a\x00b \x1c c"), (None, "hi there"), (11, "hi there"), (11, "hi there"), (12, "👍🏽 ok 👩‍👩‍👧 ﻿x ​ y"), (13, "\n"), (14, "foo\nbar\n\nbaz\n \nqux \n x"), (15, "a \u0085b\u0085 c\xa0 d e"), (16, "é\né \né")]


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a_bytes = alignment._bytes_of_a(open(BYTE_LEVEL).read())
    b_bytes = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    made, counts = [], collections.Counter()
    for doc, text in rows:
        whole = " " + (text or "")
        a, b = a_side.encode(whole, add_special_tokens=False).ids, b_side.encode(text or "")
        sides = [[a_bytes[i] for i in a], [b_bytes(i) for i in b]]
        if not text or any(b"".join(s) != whole.encode() for s in sides):
            made.append((doc, 0, 0, 0, [], ""))
            continue
        ends = []
        for side in sides:
            at, found = 0, []
            for x in side:
                at += len(x)
                found.append(at)
            ends.append(found)
        links = [(a[i], b[j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e - len(sides[0][i]) < f and f - len(sides[1][j]) < e]
        groups, before = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(k) for k, e in zip(ids, own, strict=True) if before < e <= end) for ids, own in zip((a, b), ends, strict=True)))
            before = end
        counts.update(set(links))
        made.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(((*row[:4], len(row[4]), sum(counts[p] == best[p[0]] for p in row[4]), sum(counts[p] for p in row[4]), row[5]) for row in made), key=str)


def aligned(spark, rows, kind="doc_id long, text string"):
    df = spark.createDataFrame(rows, kind)
    return sorted((tuple(r) for r in alignment.align(df, alignment.tokenizer_json(spark, BYTE_LEVEL), alignment.load(spark, MODEL)).collect()), key=str)


def test_odd_texts_match_whole_encodings(spark):
    assert aligned(spark, ODD) == plain(ODD)
    assert aligned(spark, []) == []


def test_batches_chunks_and_forgotten_pieces_change_nothing(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß1 .,-") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(40))) for k in range(60)]
    whole = plain(rows)
    assert aligned(spark, rows) == whole
    # the workers get the module's values with the pickled functions only where these are by value, so encode here
    for name, value in (("CHUNK", 2000), ("KNOWN", 50)):
        monkeypatch.setattr(alignment, name, value)
    import numpy as np

    aligner = alignment.Aligner(open(BYTE_LEVEL).read(), open(MODEL, "rb").read())
    for doc, text in rows:
        raw = (" " + text).encode()
        numbers, digests, _ = aligner.documents(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert (*numbers[0], digests[0]) == next((*r[1:5], r[7]) for r in whole if r[0] == doc)


def test_ids_of_another_kind_and_clashing_columns(spark):
    rows = [("x", "hi there", 1, 2), (None, "hi", 3, 4)]
    found = aligned(spark, rows, "doc_id string, text string, batch long, place long")
    assert [r[0] for r in found] == [None, "x"] or [r[0] for r in found] == ["x", None]
    assert sorted(r[1:] for r in found) == sorted(r[1:] for r in plain([r[:2] for r in rows]))
