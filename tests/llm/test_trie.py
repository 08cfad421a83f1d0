"""The prefix trie against plain dictionaries, and its odd rows."""

import hashlib
import random
import zlib

from ledgerloom.llm import trie

KIND = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract over tuples: every node as a key, its subtree by comparing prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    nodes, length = {}, {}
    for c, mine in own.items():
        base, h = c - c % 5, zlib.crc32(str(c).encode()) % 9
        whole = tuple(mine if base == c else own.get(base, [])[:h] + mine[h:])
        length[c] = len(whole)
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(c)
    parents = {p[:-1] for p in nodes if p}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ended = ",".join(str(c) for c in sorted(members) if length[c] == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), sum(len(q) == len(p) + 1 for q in below), sum(q not in parents for q in below), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, kind=KIND):
    return trie.trie(spark.createDataFrame(rows, kind))


def test_random_conversations_match_dictionaries(spark):
    rng = random.Random(7)
    rows = [(c, rng.choice([t, t, None]), rng.choice(["u", None, ""]), rng.choice(["a", "a", "a", "é", None])) for c in range(60) if c not in (10, 35) for t in range(rng.choice([1, 2, 3, 9, 12, 40, 300]))]
    found = made(spark, rows).collect()
    assert sorted((tuple(r)[:8] for r in found), key=str) == plain(rows)
    # the intervals: a permutation of the preorder, and every parent's holds its children's
    assert sorted(r["first"] for r in found) == list(range(len(found)))
    assert all(any(p["first"] < r["first"] and r["last"] <= p["last"] and p["depth"] == r["depth"] - 1 for p in found) for r in found if r["depth"])


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(None, 0, "u", "x", 1), (5, None, None, None, 2), (5, None, None, None, 3), (5, 0, "u", "a" * 100_000, 4), (6, 0, "u", "b", 5)]
    found = trie.trie(spark.createDataFrame(rows, KIND + ", digest long"))
    assert sorted((tuple(r)[:8] for r in found.collect()), key=str) == plain([r[:4] for r in rows])
    # a role's end is no text's start
    apart = [(0, 0, "ab", "c"), (5, 0, "a", "bc")]
    assert len(made(spark, apart).collect()) == len(plain(apart)) == 3


def test_no_conversation_has_no_node(spark):
    assert made(spark, []).collect() == [] and made(spark, [(None, 0, "u", "x")]).collect() == []


def test_pieces_of_many_copies_give_one_digest(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 40)
    rows = [(c, 0, "u", "same") for c in range(0, 1500, 5)]
    assert sorted((tuple(r)[:8] for r in made(spark, rows).collect()), key=str) == plain(rows)
