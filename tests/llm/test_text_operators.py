"""Toxicity, language, quality, licence, html and sentencepiece operators against plain Python."""

import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html, kernels, language, licenses, quality, sentencepieces, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = [None, "", " \n\t ", "a", "é b", "x" * 70_000, "one two\nthree  four\n\nfive", "Ünïcödé wörds 日本語 テスト\r\nz"]


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps", "ZETA", "#tag", "größe", "日本", "a|b"]
    lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(25)]
    return ODD + ["\n".join(rng.choices(lines, k=rng.randint(1, 30))) for _ in range(n)]


def frame(spark, texts, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:4], "doc_id long, text string" + "".join(f", {c} string" for c in more))


def test_quality_counts_match_plain_python(spark):
    texts = corpus()
    got = {r["doc_id"]: r for r in quality.signals(frame(spark, texts, lang=["en"] * len(texts))).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(got[i][c] for c in quality.BASE) == want, i


def test_binomial_tail_and_choice():
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.binomial_tail(1, 2, 0.5) == pytest.approx(0.75)
    for k, n, p in ((20, 900, 0.03), (27, 900, 0.03), (60, 900, 0.03), (3, 5000, 0.01), (-1, 5, 0.1), (5, 5, 0.1)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    clear = pd.DataFrame({"bin": [1, 30], "good": [900, 0], "bad": [0, 50]})
    cuts = quality.ladder(clear)
    assert cuts == sorted(cuts, reverse=True) and set(cuts) == {30}
    assert quality.certified(pd.DataFrame({"level": [1, quality.STEPS + 1], "good": [0, 900], "bad": [50, 0]}), 4) == 1
    # too few good documents to certify anything; good ones lost
    assert quality.certified(pd.DataFrame({"level": [1, quality.STEPS + 1], "good": [0, 20], "bad": [50, 0]}), 4) == 0
    assert quality.certified(pd.DataFrame({"level": [1, quality.STEPS + 1], "good": [30, 870], "bad": [5000, 0]}), 4) == 0


def test_quality_rules_together_keep_to_the_bound():
    """Four rules each lose 2 to 3 % of the good documents, other ones each: drawn often, the joint loss exceeds alpha rarely."""
    rng = np.random.default_rng(4)
    risk = quality.Risk(price=0.5)
    beyond = used = 0
    for _ in range(200):
        rate = rng.uniform(0.0, 0.03, 4)
        losses = []
        for _half in range(2):
            which = rng.choice(5, 3000, p=[*rate, 1 - rate.sum()])
            losses.append([int((which == r).sum()) for r in range(4)])
        counts = lambda lost: pd.DataFrame({"bin": [0, 20], "good": [3000 - lost, lost], "bad": [0, 4000]})
        cuts = [quality.ladder(counts(x), risk) for x in losses[0]]
        first = [next((t + 1 for t, c in enumerate(cut) if c <= 20), quality.STEPS + 1) for cut in cuts]
        levels = [*first, quality.STEPS + 1]
        held = pd.DataFrame({"level": levels, "good": [*losses[1], 3000 - sum(losses[1])], "bad": [4000] * 5})
        step = quality.certified(held, 1, risk)
        lost = sum(p for p, f in zip(rate, first) if f <= step)
        used += step > 0
        beyond += lost > risk.alpha
    assert used > 100 and beyond <= 0.05 * 200


def test_quality_verdicts_match_plain_python(spark):
    rng = random.Random(8)
    texts, langs, good = [], [], []
    for i in range(4500):
        bad = rng.random() < 0.3
        words = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(40, 90))]
        share = rng.choice([0, 0.02, 0.1]) if not bad else rng.choice([0.2, 0.4])
        words = [w + "#" * rng.randint(1, 3) if rng.random() < share else w for w in words]
        if bad and rng.random() < 0.4:
            words = [w.upper() for w in words]
        texts.append(" ".join(words) + ("\nsame line\nsame line" if rng.random() < 0.1 else ""))
        langs.append(rng.choice(["en", "de", None]))
        good.append(int(not bad))
    docs = frame(spark, texts, lang=langs, good=["x"] * 4500, stratum=["y"] * 4500, n_words=["z"] * 4500)
    labels = spark.createDataFrame(list(enumerate(good))[:4200], "doc_id long, good int")
    got = {r["doc_id"]: r for r in quality.rules(docs, labels).collect()}
    half = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2))).collect()}
    risk = quality.Risk()

    def bins(text):
        words = text.split()
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        chars, lines = sum(map(len, words)), [x for x in text.split("\n") if x.split()]
        ratio = {
            "symbols": sum(c in "#*$%&|<>" for c in text) / chars,
            "dup_lines": (len(lines) - len(set(lines))) / len(lines),
            "repeats": len(again) / len(words),
            "upper": sum("A" <= c <= "Z" for c in text) / chars,
            "word_length": chars / len(words),
        }
        fails = len(words) < 50 or 100 * len(again) > 50 * len(words)
        return fails, {r: min(quality.GRID, max(0, math.ceil(ratio[r] / (top / quality.GRID)) - 1)) for r, top in quality.RULES.items()}

    seen = [bins(t) for t in texts]
    cut = {}
    for lang in ("en", "de", None):
        mine = [i for i in range(4200) if langs[i] == lang and not seen[i][0]]
        first = [i for i in mine if half[i] == 0]
        held = [i for i in mine if half[i] == 1]
        reject = lambda i, cuts: any(seen[i][1][r] >= c for r, c in cuts.items())
        steps, worth = [], 0.0
        for t in range(1, quality.STEPS + 1):
            cuts = {}
            for r in quality.RULES:
                best = (0.0, quality.GRID + 1)
                for b in range(quality.GRID, 0, -1):
                    lost = sum(good[i] for i in first if seen[i][1][r] >= b)
                    caught = sum(1 - good[i] for i in first if seen[i][1][r] >= b)
                    if lost <= risk.alpha * t / quality.STEPS * sum(good[i] for i in first) and caught - risk.price * lost > best[0]:
                        best = caught - risk.price * lost, b
                cuts[r] = best[1]
            steps.append(cuts)
        for cuts in steps:
            lost, n = sum(good[i] for i in held if reject(i, cuts)), sum(good[i] for i in held)
            if sum(math.comb(n, k) * risk.alpha**k * (1 - risk.alpha) ** (n - k) for k in range(lost + 1)) > risk.delta / 3:
                break
            value = sum(1 - good[i] for i in held if reject(i, cuts)) - risk.price * lost
            if value > worth:
                worth, cut[lang] = value, cuts
    for i in range(4500):
        want = not seen[i][0] and not any(seen[i][1][r] >= c for r, c in cut.get(langs[i], {}).items())
        assert (got[i]["base_failed"], got[i]["kept"]) == (seen[i][0], want), i
    assert cut and any(not seen[i][0] and not got[i]["kept"] for i in range(4500))


def test_quality_verdicts_keep_clean_documents(spark):
    rng = random.Random(3)
    clean = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(80)) for _ in range(600)]
    noisy = [" ".join(f"w{rng.randint(0, 5000)}###" for _ in range(80)) for _ in range(60)]
    texts = clean + noisy + [None, ""]
    docs = frame(spark, texts, lang=["en"] * len(texts))
    labels = spark.createDataFrame([(i, 1 if i < 600 else 0) for i in range(660)] + [(None, 1), (5, None), (5, 1)], "doc_id long, good int")
    got = {r["doc_id"]: r for r in quality.rules(docs, labels).collect()}
    assert all(got[i]["kept"] for i in range(600))
    assert not any(got[i]["kept"] for i in range(600, 662))
    assert all(not got[i]["base_failed"] for i in range(660)) and got[660]["base_failed"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.rules(empty, labels).count() == 0


def test_toxicity_learns_words_and_handles_odd_texts(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts, label = [], []
    for _ in range(900):
        bad = rng.random() < 0.2
        words = [word() for _ in range(60)]
        if bad:
            words[rng.randint(0, 59)] = rng.choice(["vile", "nasty"])
        texts.append(" ".join(words))
        label.append(int(bad))
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame(list(enumerate(label)) + [(None, 1), (3, None)], "doc_id long, label int")
    got = {r["doc_id"]: r for r in toxicity.predict(docs, labels, F.col("doc_id") % 3 == 1).collect()}
    held = [i for i in range(900) if i % 3 == 1]
    right = sum(got[i]["predicted"] == label[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= got[i]["score"] <= 1 for i in got) and len(got) == 900 + len(ODD)
    none = toxicity.predict(docs, labels.where("false"), F.lit(False)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, labels)).count() == 0


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    examples = [(float(k % 2), np.unique(np.append(rng.integers(10, 1 << 20, 30), k % 2))) for k in range(400)]
    index, values, _ = toxicity.fit_examples(examples, toxicity.Ftrl())
    assert len(index) < 200 and {0, 1} <= set(index.tolist())


def test_language_profiles(spark):
    rng = random.Random(7)
    sound = {"aa": ["ba", "lo", "ki"], "bb": ["schr", "ung", "pf"], "cc": ["ção", "lh", "nh"]}
    make = lambda k: " ".join("".join(rng.choices(sound[k], k=3)) for _ in range(rng.randint(5, 60)))
    langs = [rng.choice(list(sound)) for _ in range(300)]
    texts = [make(k) for k in langs]
    docs = frame(spark, texts + ODD, lang=langs + [None] * len(ODD))
    got = {r["doc_id"]: r for r in language.predict(docs, F.col("doc_id") % 5 == 0).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(300))
    assert [got[300 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(docs.where("false"), F.lit(False)).count() == 0
    alone = language.identify(docs, []).collect()
    assert {r["lang_pred"] for r in alone} == {"und"}


def test_language_bundle_equals_plain_sum():
    text = "Abc, éab"
    data = np.frombuffer(text.encode(), np.uint8)
    got, letters = language.bundles(data, np.array([0, len(data)]), 128)
    folded = "abc éab"
    vec = lambda c: language.letter_vectors(np.array([ord(c)]), 128)[0].astype(int)
    want = sum(np.roll(vec(a), 2) * np.roll(vec(b), 1) * vec(c) for a, b, c in zip(folded, folded[1:], folded[2:]))
    assert (got[0] == want).all() and letters[0] == 6


def brute_license(text, threshold=licenses.THRESHOLD):
    words = licenses.plain_words(text)
    grams = list(zip(words, words[1:]))
    best = []
    for k, (name, template) in enumerate(licenses.TEMPLATES.items()):
        t = licenses.plain_words(template)
        own = Counter(zip(t, t[1:]))
        size, top = sum(own.values()), 0.0
        longest = int(size * (2 - threshold) / threshold)
        for i in range(len(grams)):
            for j in range(i, min(len(grams), i + longest)):
                if grams[i] in own and grams[j] in own:
                    top = max(top, 2 * sum((Counter(grams[i : j + 1]) & own).values()) / (size + j - i + 1))
        if top >= threshold:
            best.append((-top, -size, k, name))
    return [x[3] for x in sorted(best)], -min(best)[0] if best else 0.0


def test_license_scan_matches_brute_force(spark):
    short = [x for k, x in licenses.TEMPLATES.items() if len(x) < 120]
    texts = ["text before. " + s + " and after" for s in short] + [s.upper().replace(" ", "\n") for s in short] + ["Licensed under the new Apache License Version 2.0", "the license", *ODD[:5]]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        names, dice = brute_license(t)
        assert got[i]["licenses"] == names and got[i]["dice"] == pytest.approx(dice), t
    whole = frame(spark, ["junk " * 50 + licenses.TEMPLATES["MIT"] + " junk" * 50])
    assert licenses.scan(whole).first()["license"] == "MIT"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></ul></nav><script>var a="</p><article>";</script><div class="cookie-notice">We use cookies, ok?</div>
<div id=main-content><h1>Head &amp; line</h1><p>First <b>par</b>agraph, with&nbsp;commas, and   space.<p>Second &eacute; paragraph, unclosed, long enough to be scored here.
<form><p>Sign up to the list, please, now</p></form><ul><li>point one<li>point two</ul><!-- <p>no</p> --></div>
<aside><p>Side text, with commas, long enough to be scored as a paragraph, yes.</p></aside>
<div class="comments"><p>A reader, who comments, at length, on all of this, with many, many commas.</p></div><footer>Foot</footer></body></html>"""


def test_html_main_text(spark):
    assert html.main_text(PAGE) == "Head & line\nFirst paragraph, with commas, and space.\nSecond é paragraph, unclosed, long enough to be scored here.\npoint one\npoint two"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("just text &lt;b&gt;") == "just text <b>"
    assert html.main_text("<p>a<" + "div" * 3) is not None
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", "")], "page_id long, url string, html string")
    rows = html.extract(pages).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [len(html.main_text(PAGE)), 0, 0]


def test_html_article_with_sections():
    body = "".join(f"<section><h2>Part {i}</h2><p>{'word, ' * 20}end {i}.</p></section>" for i in range(3))
    page = f"<body><div class=menu><a>x</a></div><article><header><h1>Title</h1><p class=byline>By me</p></header>{body}<section class='related'><p>More, more, more</p></section></article></body>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "Title" and [x for x in lines if x.startswith("Part")] == ["Part 0", "Part 1", "Part 2"] and "More, more, more" not in lines


def test_html_wrappers_comments_and_forms():
    word = "Long enough, with commas, to be a paragraph of the article, yes."
    wrapped = f"<div class='page with-sidebar'><div id='sidebar'><p>{word} No.</p></div><div class='site-header-wrap'><article class='post'><p>{word}</p></article></div></div>"
    assert html.main_text(wrapped) == word
    talk = f"<main><p>{word}</p><section id='reader-comments'><article class='comment'><p>{word} No.</p></article></section><div class='commentlist'><p>{word} No.</p></div></main>"
    assert html.main_text(talk) == word
    assert html.main_text(f"<body><form id=aspnet><div class=content><p>{word}</p></div></form></body>") == word
    assert html.main_text(f"<div role='banner'>x</div><div><p>{word}</p><p>{word} Two.</p></div><div aria-hidden=true>y</div><p style='display:none'>z</p>") == f"{word}\n{word} Two."


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = corpus() + ["  two  spaces ", "tab\there\n\n", "emoji 😀 fallback", "▁literal ▁mark"]
    model = sentencepieces.load(spark, MODEL)
    coded = sentencepieces.encode(frame(spark, texts), model)
    rows = {r["doc_id"]: r for r in coded.collect()}
    for i, t in enumerate(texts):
        assert list(rows[i]["ids"]) == own.encode(t or ""), i
        assert rows[i]["parity"] and rows[i]["n_tokens"] == len(rows[i]["ids"])
        assert rows[i]["round_trip"] or "▁" in t
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(coded, model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))


def unigram_model():
    """A small unigram model, written field by field."""
    text = lambda n, b: bytes([n << 3 | 2]) + bytes([len(b)]) + b
    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] + [("▁", -3.0, 1), ("▁ab", -2.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("c", -4.5, 1), ("bc", -5.0, 1), ("abc", -9.0, 1)]
    out = b"".join(text(1, text(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # model_type 1, byte_fallback (35)
    return out + text(2, trainer) + text(3, b"\x18\x01\x20\x01\x28\x01")


def test_unigram_model_with_byte_fallback():
    import sentencepiece

    data = unigram_model()
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepieces.Codec(data)
    for t in ["abc", "ab c", "  ab   abc ", "zé", "", "aabbcc abc"]:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, at, parity = codec.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == own.encode(t), t
        assert parity.all()


def test_kernels_split_like_bytes_split():
    texts = [t or "" for t in corpus()]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    docs, starts, ends = kernels.spans(~kernels.space(data), offsets)
    got = [[] for _ in texts]
    for d, a, b in zip(docs, starts, ends):
        got[d].append(data[a:b].tobytes())
    assert got == [r.split() for r in raw]
    of, s, e = kernels.line_spans(data, offsets)
    lines = [[] for _ in texts]
    for d, a, b in zip(of, s, e):
        lines[d].append(data[a:b].tobytes())
    assert lines == [r.split(b"\n") for r in raw]
    h = kernels.span_hashes(data, starts, ends)
    words = [w for r in raw for w in r.split()]
    assert len(set(h.tolist())) == len(set(words))


def test_html_keeps_hidden_and_math_text_of_the_article():
    word = "Long enough, with commas, to be a paragraph of the article, yes."
    page = f"<article><p>{word}</p><p hidden>{word} Hid.</p><p>Let <math><mi>x</mi></math> be it, as long as it gets here, for sure.</p><div style='display:none'>End, of it</div></article>"
    assert html.main_text(page) == f"{word}\n{word} Hid.\nLet x be it, as long as it gets here, for sure.\nEnd, of it"


def random_page(rng):
    word = lambda: rng.choice(["alpha", "beta,", "gamma", "&amp;", "delta,", "é"])
    text = lambda: " ".join(word() for _ in range(rng.randint(1, 40)))
    out = []
    for _ in range(rng.randint(5, 60)):
        name = rng.choice(["div", "p", "section", "a", "ul", "li", "span", "td", "h2", "article", "b"])
        out.append(rng.choice([f"<{name}>", f"</{name}>", f"<{name} class='x y'>", text(), text(), f"<a href=z>{text()}</a>", f"<p>{text()}</p>"]))
    return "".join(out)


def test_html_scores_match_plain_sums_over_ancestors():
    rng = random.Random(2)
    for _ in range(200):
        tree = html._Tree(random_page(rng))
        blocks = [b for b in tree.blocks if not tree.dropped[b[0]]]
        size = len(tree.tag)
        points, chars, linked = [0.0] * size, [0] * size, [0] * size
        for owner, text, in_links in blocks:
            line = list(tree.above(owner))
            for n in line:
                chars[n] += len(text)
                linked[n] += in_links
            worth = ((1.0 if len(text) >= 25 else 0.2) + text.count(",") + min(len(text) / 100, 3.0)) * (1 - in_links / len(text))
            holds = tree.tag[owner] in {"div", "section", "article", "main", "body", "td", "#root", "html"}
            for depth, n in enumerate(line[0 if holds else 1 :][: html.LEVELS]):
                points[n] += worth / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
        score, got_chars, density = html.scores(tree, blocks)
        assert got_chars == chars
        assert density == pytest.approx([y / x if x else 0.0 for x, y in zip(chars, linked)])
        assert score == pytest.approx([p * (1 - d) for p, d in zip(points, density)])


def test_html_takes_time_in_proportion_to_malformed_pages():
    word = "Some words, long enough, to be the text of this page."
    shapes = ["<a ", "<div>", "<!-- x", "<! ", '<a x=">"', "<script></script ", "<b>", "<ul><li>x", "<article>", "</x>", "<i><div>", '<a b="1" ']
    for shape in shapes:
        times = []
        for n in (20_000, 80_000):
            began = time.process_time()
            html.main_text(f"<p>{word}</p>" + shape * n)
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 1, (shape, times)
    assert html.main_text(f"<p>{word}</p>" + "<!-- x" * 1000) == word
    assert html.main_text(f"<p>{word}</p><div a='>'><p>More, of it, and more, to read here.</p><a b='").startswith(word)
    long = "\n".join([word] * 50_000)
    assert html.main_text("<p>" + long.replace("\n", "<p>")) == long


def test_html_rows_stand_for_themselves(spark):
    word = "Some words, long enough, to be the text of this page."
    rows = [(1, "u", f"<p>{word}", "x"), (1, "u", f"<p>{word}", "y"), (None, None, None, None), (2, "", "  ", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(pages).collect()))
    assert got == [(0, "", 0), (1, word, len(word)), (1, word, len(word)), (2, "", 0)]
    assert html.extract(pages.where("false")).count() == 0


def test_a_task_gives_its_memory_back_and_passes_batches_and_errors_through():
    @kernels.tidy
    def run(batches):
        kernels.powers(3 * kernels.CHUNK_BYTES)
        for batch in batches:
            if batch is None:
                raise ValueError("bad batch")
            yield batch

    assert list(run(iter([1, 2]))) == [1, 2]
    assert len(kernels._POWERS[0]) == 1
    with pytest.raises(ValueError, match="bad batch"):
        list(run(iter([1, None])))
    data = np.frombuffer("der zug kam".encode(), np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 11])
    before = kernels.span_hashes(data, starts, ends)
    assert (kernels.span_hashes(data, starts, ends) == before).all()
    kernels.give_back()
    assert (kernels.span_hashes(data, starts, ends) == before).all()
