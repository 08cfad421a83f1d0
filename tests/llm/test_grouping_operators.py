"""Near-dedup, line dedup, embedding, graph and mixing operators against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embeddings, graph, kernels, linededup, mixing, neardup, quality


def united(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    want = united({x for e in edges for x in e}, edges)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert all(want[i] == c for i, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 8)):
            copy = base[:]
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    line = " ".join(word() for _ in range(30))
    texts += [line + " " + " ".join(word() for _ in range(40)) for _ in range(30)]
    texts += [None, None, "", "", " \n", "one two", "one two", "one  two", "x" * 50_000, texts[0], texts[0]]
    rng.shuffle(texts)
    return texts


def shingles(text):
    words = text.split()
    return set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)} if words else set()


def brute_similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(1, len(x | y))


def test_near_dedup_matches_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, texts[0], "z")], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    known = [(i, t) for i, t in enumerate(texts) if t is not None]
    pairs = [(i, j) for k, (i, a) in enumerate(known) for j, b in known[k + 1 :] if a == b or brute_similarity(a, b) >= 0.8]
    assert got == united(range(len(texts)), pairs)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(got.values())) and ids.count(None) == 1
    assert neardup.classes(docs.where("false")).count() == 0


def test_near_dedup_beyond_the_hub(spark):
    """Pairs of heavily edited copies that are similar to each other and not to the hub are found."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 9000)}"
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(25):
        copy = base[:]
        for _ in range(rng.randint(0, 25)):
            copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
        for _ in range(2):
            second = copy[:]
            second[rng.randrange(200)] = word()
            texts.append(" ".join(second))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if brute_similarity(texts[i], texts[j]) >= 0.8]
    assert got == united(range(len(texts)), pairs)


def test_near_dedup_of_copies_that_repeat_a_passage(spark):
    """A passage that one copy has 40 times and the other once counts once."""
    rng = random.Random(12)
    texts = []
    for k in range(24):
        words = [f"p{k}x{rng.randint(0, 90_000)}" for _ in range(339)]
        passage = [f"q{k}x{rng.randint(0, 90_000)}" for _ in range(64)]
        texts += [" ".join(passage * 40 + words[:304]), " ".join(passage + words[28:])]
    alike = [brute_similarity(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert 0.8 <= min(alike) and max(alike) < 0.85
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_near_dedup_misses_as_few_pairs_by_registers_as_by_bands():
    bands = (1 - neardup.THRESHOLD**neardup.ROWS) ** neardup.BANDS
    for least in (neardup.ESTIMATE, neardup.LIKELY):
        assert quality.binomial_tail(math.ceil(least * neardup.REGISTERS) - 1, neardup.REGISTERS, neardup.THRESHOLD) <= bands


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    x, y = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    x[:40], y[-40:] = 0, 0
    docs = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    sig = neardup.signatures(docs, np.concatenate([elements[x > 0], elements[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 4096)
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / np.maximum(x / x[d], y / y[d]).sum() for d in both)
    assert abs((sig[0] == sig[1]).mean() - want) < 5 * math.sqrt(want * (1 - want) / 4096)


def test_short_texts_are_one_shingle():
    data = np.frombuffer(b"a b c d e f g h", np.uint8)
    docs, starts, ends = kernels.spans(~kernels.space(data), np.array([0, 5, 15]))
    of, sh = kernels.shingles(docs, kernels.span_hashes(data, starts, ends))
    assert sorted(of.tolist()) == [0, 1] and len(set(sh.tolist())) == 2


def brute_lines(docs, least):
    """Positions to delete: every line within a run of lines that occurs before, tried run by run."""
    seqs = {d: [(p, x.strip(" \t\n\x0b\x0c\r")) for p, x in enumerate(t.split("\n")) if x.split()] for d, t in docs.items() if t is not None}
    size = lambda run: sum(len(x.split()) for _, x in run)
    first = {}
    runs = []
    for d in sorted(seqs):
        for i in range(len(seqs[d])):
            for j in range(i + 1, len(seqs[d]) + 1):
                run = seqs[d][i:j]
                if size(run) >= least:
                    key = tuple(x for _, x in run)
                    runs.append((d, i, j, key))
                    first.setdefault(key, (d, i))
    gone = defaultdict(set)
    for d, i, j, key in runs:
        e, k = first[key]
        if e != d or k + (j - i) <= i:
            gone[d] |= {p for p, _ in seqs[d][i:j]}
    return gone


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 6))) for _ in range(14)]
    docs = {i: "\n".join(rng.choices(lines, k=rng.randint(0, 14))) for i in range(25)}
    docs |= {25: None, 26: "", 27: "\n\n \n", 28: docs[3], 29: "a b c\n" * 12, 30: "  " + docs[3].replace("\n", " \n\n"), 31: "solo line here only"}
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs.items()] + [(3, docs[3], 6), (None, docs[3], 7)], "doc_id long, text string, n_gone int")
    rows = linededup.dedup(frame, 8).collect()
    want = brute_lines(docs, 8)
    for r in rows:
        text = docs[r["doc_id"]] if r["doc_id"] is not None else docs[3]
        cut = want.get(r["doc_id"], set()) if r["doc_id"] is not None else set()
        kept = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut)
        assert r["text"] == kept and r["n_gone"] == len(cut), r["doc_id"]
    assert len(rows) == len(docs) + 2
    assert linededup.dedup(frame.where("false"), 8).count() == 0
    plain = linededup.dedup(frame.where("doc_id = 31"), 8).first()
    assert plain["text"] == docs[31] and plain["n_lines"] == 1


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    vectors = [v + rng.normal(size=16) * s for v in base for s in (0, 0.02, 0.1, 0.25)]
    vectors += [vectors[0]] * 3 + [vectors[5] * 2]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0] * 15), (n + 4, []), (n + 5, [None] * 16), (n + 6, [float("inf")] + [0.0] * 15), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in embeddings.link(frame, recall=1.0).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = united(range(n), zip(*np.nonzero(near)))
    found = sum(got[i]["n_links"] for i in range(n))
    assert 0.97 * near.sum() <= found <= near.sum()
    assert all(got[i]["n_links"] <= near[i].sum() for i in range(n))
    assert sum(got[i]["component_id"] == comp[i] for i in range(n)) >= 0.97 * n
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.link(frame.where("false")).count() == 0
    assert embeddings.link(frame.where(f"vec_id >= {n}")).count() == 7


def test_embedding_blocks_count_each_link_once(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=8) + rng.normal(size=(1300, 8)) * 0.01
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = embeddings.link(frame, recall=1.0).agg(F.min("n_links"), F.max("n_links"), F.max("component_id")).first()
    assert got[0] >= 1290 and tuple(got)[1:] == (1299, 0)


def test_embedding_recall_at_production_settings(spark):
    """Pairs just above the threshold, their differences in all directions or in few, among unrelated vectors of two lengths."""
    rng = np.random.default_rng(21)
    rows, want = [], {}

    def add(x):
        first, x = len(rows), x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        rows.extend((first + i, v.tolist()) for i, v in enumerate(x))
        want.update({first + i: int(n) for i, n in enumerate(near.sum(1))})
        return int(near.sum())

    def copies(base, few):
        noise = rng.normal(size=base.shape)
        if few:
            noise[:, 4:] = 0
        noise -= (noise * base).sum(1)[:, None] * base
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        cos = rng.uniform(0.9, 0.94, len(base))[:, None]
        return cos * base + np.sqrt(1 - cos**2) * noise

    base = rng.normal(size=(2500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=(300, 20))
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    total = add(np.concatenate([base, copies(base[:800], False), copies(base[800:1600], True)])) + add(np.concatenate([other, copies(other, False)]))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("a", F.lit("x")).withColumn("cell", F.lit("y"))
    got = {r["vec_id"]: r["n_links"] for r in embeddings.link(frame).collect()}
    assert total >= 3600 and all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.95 * total
    assert sum(got[i] for i in range(len(rows) - 600, len(rows))) >= 0.9 * sum(want[i] for i in range(len(rows) - 600, len(rows)))


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(9), rng.random(7)
    got = embeddings.traverse(a, b, 63)
    total = (a[:, None] + b[None]).reshape(-1)
    assert sorted(got) == list(range(63)) and np.all(np.diff(total[got]) >= 0)


def brute_targets(sizes, repeat=3):
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(repeat * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > repeat * sizes[s]}
        if not over:
            return {s: float(repeat * sizes[s]) if s in full else share[s] for s in sizes}
        full |= over


def test_mixing_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), rng.choice("aaaaaabcdefg") if i % 17 else None) for i in range(700)]
    rows += [(700, None, "a"), (701, "", "zz"), (3, rows[3][1], rows[3][2]), (None, "a b", "b")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, block_words=8, shard_rows=50).collect()
    assert len(got) == len(rows)
    key = lambda s: "\U0010ffff" if s is None else s
    sizes = Counter()
    for _, t, s in rows:
        sizes[key(s)] += len((t or "").split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[key(r["source"])] and r["target"] == pytest.approx(want[key(r["source"])])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[key(r["source"])] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 16 for s in want)
    again = mixing.mix(docs.repartition(7), block_words=8, shard_rows=50)
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again.collect())
    mixed = mixing.apply(docs, block_words=8, shard_rows=50)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[key(r["source"])] += len(r["text"].split())
    assert out == Counter({s: n for s, n in taken.items() if n})
    assert mixing.mix(docs.where("false")).count() == 0


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 50, 333):
        shares = [rng.choice([0, 1, 3, 10, 200, 5000]) for _ in range(23)]
        parts = spark.createDataFrame([(i, float(s), seats) for i, s in enumerate(shares)], "k int, share double, seats long")
        got = {r["k"]: r["quota"] for r in mixing.apportion(parts, [], "share", "seats", ["k"]).collect()}
        want = Counter()
        for _ in range(seats):
            want[max((k for k in range(23) if shares[k]), key=lambda k: (shares[k] / (2 * want[k] + 1), -k))] += 1
        assert got == {k: want[k] for k in range(23)}
