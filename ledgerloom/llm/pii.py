"""Personal data in texts by candidate gradient boosting, in DataFrame functions only.

Fixed patterns give the base spans. Wider generators propose further, overlapping candidates with features of format and
context. Candidates that are base spans are positive examples, those that fail the check of their kind (digits, Luhn,
parts) negative ones; the rest, such as a number that a longer match has swallowed, is what the model decides. Boosted
trees are fitted on the counts of distinct feature vectors, half of which choose each kind's threshold for a
wanted precision. Trees become one expression, so texts are scored where they are read, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, spelt so that Java matches them in linear time and without recursion: possessive, with
#: group loops only where they don't recurse, and starting only where a run of their characters starts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]{12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Separators that stand between two digits are a card's; all others end it. Replacing them keeps positions.
LONE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
#: Kind, what a candidate looks like.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]{1,63}+){1,8}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}(?:\.|\[\.\])[0-9]{1,4}(?:\.|\[\.\])[0-9]{1,4}(?:\.|\[\.\])[0-9]{1,4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{4,6}[\x20.-][0-9]{4,5}(?:[\x20.-][0-9]{1,4})?(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What stands before a candidate says what it is; the last class speaks against all kinds.
WORDS = ("mail|contact|write", "host|server|address|ip", "card|visa|pay|account", "phone|call|tel|fax|mobile", "version|token|password|key|isbn|order|id")
#: Each feature and its largest value, all from 0: at most the product of these many vectors are counted.
FEATURES = {"kind": 3, "valid": 1, "digits": 20, "left": 4, "right": 4, "marks": 6, "word": 5, "lead": 3, "distinct": 10}
BLOCK = 64


def located(df: DataFrame, patterns: dict[str, tuple[str, str]], drop: list[str]) -> DataFrame:
    """``df`` without ``drop`` and, for each name: (text, pattern), an array of the matches: start and end in code points, the match, what is left and right of it.

    A match starts after all pieces before it. Their lengths are summed in blocks of ``BLOCK``, then the
    blocks, so a text with very many matches takes little more than linear time. All patterns go step by step
    together, so that only what the steps need is passed on, not the texts.
    """
    keep = [c for c in df.columns if c not in drop]
    quoted = {n: (text, pattern.replace("\\", "\\\\").replace("'", "\\'")) for n, (text, pattern) in patterns.items()}
    plus = "0L, (a, x) -> a + x"
    steps = [
        {"m": "regexp_extract_all({t}, '{p}', 0)", "s": "transform(split({t}, '{p}', -1), x -> named_struct('n', cast(length(x) as bigint), 'before', right(x, 16), 'after', left(x, 1)))"},
        {"l": "transform({m}, (x, i) -> {s}[i].n + length(x))"},
        {"b": f"if(size({{l}}) = 0, array(0L), transform(sequence(0, (size({{l}}) - 1) div {BLOCK}), k -> aggregate(slice({{l}}, cast(k * {BLOCK} + 1 as int), {BLOCK}), {plus})))"},
        {"c": f"transform({{b}}, (x, k) -> aggregate(slice({{b}}, 1, k), {plus}))"},
        {"p": f"transform({{l}}, (l, i) -> {{c}}[i div {BLOCK}] + aggregate(slice({{l}}, cast((i div {BLOCK}) * {BLOCK} + 1 as int), cast(i % {BLOCK} as int)), {plus}) + {{s}}[i].n)"},
    ]
    for k, step in enumerate(steps):
        made = [F.expr(e.format(t=t, p=p, **{c: f"{n}_{c}" for c in "mslbc"}) if k else e.replace("{t}", t).replace("{p}", p)).alias(f"{n}_{c}") for n, (t, p) in quoted.items() for c, e in step.items()]
        df = df.select(*(c for c in df.columns if c not in drop), *made)
    found = "transform({m}, (x, i) -> named_struct('start', {p}[i], 'end', {p}[i] + length(x), 'match', x, 'before', {s}[i].before, 'after', {s}[i + 1].after))"
    return df.select(*keep, *[F.expr(found.format(**{c: f"{n}_{c}" for c in "msp"})).alias(n) for n in patterns])


def luhn(digits: str) -> str:
    """SQL: whether the digits of an expression pass Luhn's check."""
    digit = f"cast(substr({digits}, length({digits}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, j) -> a + if(j % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10 = 0"


def valid(kind: str, match: str) -> str:
    """SQL: whether a match is of its kind."""
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    if kind == "email":
        return "true"
    if kind == "ip":
        dotted = f"replace(replace({match}, '[', ''), ']', '')"
        return f"{dotted} rlike '^{BYTE}([.]{BYTE}){{3}}$'"
    if kind == "card":
        return f"case when length({digits}) between 13 and 19 then {luhn(digits)} else false end"
    return f"length({digits}) between 9 and 15"


def _side(char: str) -> str:
    return f"case when {char} = '' or {char} rlike '^\\\\s' then 0 when {char} rlike '^[A-Za-z]' then 1 when {char} rlike '^[0-9]' then 2 when {char} rlike '^[.,;:!?)]' then 3 else 4 end"


def _features(kind: str) -> str:
    digits = "regexp_replace(x.match, '[^0-9]', '')"
    words = " ".join(f"when lower(x.before) rlike '({w})[^a-z0-9]*$' then {k + 1}" for k, w in enumerate(WORDS))
    lead = "case when x.match rlike '^[0-9]' then 0 when x.match rlike '^[+]' then 1 when x.match rlike '^[(]' then 2 else 3 end"
    values = {"kind": str(KINDS.index(kind)), "valid": f"if({valid(kind, 'x.match')}, 1, 0)", "digits": f"least(length({digits}), 20)", "left": _side("right(x.before, 1)"), "right": _side("x.after"), "marks": "least(length(regexp_replace(x.match, '[A-Za-z0-9]', '')), 6)", "word": f"case {words} else 0 end", "lead": lead, "distinct": f"least(size(array_distinct(split({digits}, ''))), 10)"}
    return "named_struct(" + ", ".join(f"'{n}', {values[n]}" for n in FEATURES) + ", 'start', x.start, 'end', x.end, 'match', x.match)"


def found(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs``, its text replaced by ``base`` and ``candidates``: arrays of structs with kind (its place in ``KINDS``), start and end; candidates also have features."""
    text = F.col(text_col)
    df = docs.withColumn("_t", F.when(text.rlike("[0-9@]"), text).otherwise(F.lit(""))).drop(text_col)
    df = df.withColumn("_d", F.regexp_replace("_t", LONE, "\n"))
    patterns = {f"_{k}": ("_d" if k == "card" else "_t", p) for k, p in BASE.items()} | {f"_g{k}": ("_t", p) for k, (_, p) in enumerate(GENERATORS)}
    df = located(df, patterns, ["_t", "_d"])
    base = [F.expr(f"transform(filter(_{k}, x -> {valid(k, 'x.match')}), x -> named_struct('kind', {KINDS.index(k)}, 'start', x.start, 'end', x.end))") for k in KINDS]
    candidates = [F.expr(f"transform(_g{n}, x -> {_features(k)})") for n, (k, _) in enumerate(GENERATORS)]
    return df.select(*(c for c in df.columns if c not in patterns), F.concat(*base).alias("base"), F.concat(*candidates).alias("candidates"))


def examples(spans: DataFrame) -> DataFrame:
    """Distinct feature vectors with fold, and how many candidates are positive and negative."""
    # the outer form: a filter on the candidates would be pushed below and find them twice
    one = spans.select(F.explode_outer("candidates").alias("c"), "base")
    same = F.exists("base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))
    label = F.when(same, 1).when(F.col("c.valid") == 0, 0)
    rows = one.select("c.*", label.alias("label")).where("label is not null")
    fold = F.crc32(F.col("match").cast("binary")) % 2
    return rows.groupBy(*FEATURES, fold.alias("fold")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def tree_sql(tree, at: str = "") -> str:
    """A tree, (feature, cut, low, high) or a weight, as SQL over features that stand after ``at``."""
    if isinstance(tree, float):
        return f"{tree!r}D"
    name, cut, low, high = tree
    return f"case when {at}{name} <= {cut} then {tree_sql(low, at)} else {tree_sql(high, at)} end"


def margin_sql(trees: list, at: str = "") -> str:
    return " + ".join(f"({tree_sql(t, at)})" for t in trees) or "0.0D"


def boost(table: DataFrame, rounds: int = 8, rate: float = 0.5, ridge: float = 1.0) -> list:
    """Trees of two levels fitted by second-order gradient boosting of the logistic loss; an empty list without examples.

    Spark sums gradients by node, feature and value; only these sums, at most three nodes of all features' values,
    come to the driver.
    """
    totals = table.agg(F.sum("pos"), F.sum("neg")).head()
    pos, neg = float(totals[0] or 0), float(totals[1] or 0)
    if pos + neg == 0:
        return []
    trees: list = [math.log((pos + 1) / (neg + 1))]
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in FEATURES]), F.array(*[F.col(n) for n in FEATURES])))

    def best(node: str) -> dict:
        """Of each node: gain, feature, cut and the weights of both sides."""
        p = F.expr(f"1 / (1 + exp(-({margin_sql(trees)})))")
        step = table.select("*", p.alias("_p"), F.expr(node).alias("node"))
        step = step.select("node", (F.col("_p") * (F.col("pos") + F.col("neg")) - F.col("pos")).alias("g"), (F.col("_p") * (1 - F.col("_p")) * (F.col("pos") + F.col("neg"))).alias("h"), pairs.alias("f", "v"))
        sums = step.groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        found: dict = {}
        for key in sorted({(r["node"], r["f"]) for r in sums}):
            rows = sorted((r["v"], r["g"], r["h"]) for r in sums if (r["node"], r["f"]) == key)
            g, h, a, b = sum(r[1] for r in rows), sum(r[2] for r in rows), 0.0, 0.0
            weight = lambda x, y: -rate * x / (y + ridge)
            # without a split the node is a leaf
            found.setdefault(key[0], (0.0, None, None, weight(g, h), 0.0))
            for v, x, y in rows[:-1]:
                a, b = a + x, b + y
                gain = a * a / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g * g / (h + ridge)
                if gain > found[key[0]][0] + 1e-9:
                    found[key[0]] = (gain, key[1], v, weight(a, b), weight(g - a, h - b))
        return found

    for _ in range(rounds):
        _, name, cut, low, high = best("0")[0]
        if name is None:
            break
        sides = best(f"case when {name} <= {cut} then 1 else 2 end")
        leaf = lambda k, own: own if sides.get(k, (0, None))[1] is None else (sides[k][1], sides[k][2], sides[k][3], sides[k][4])  # noqa: E731, B023
        trees.append((name, cut, leaf(1, low), leaf(2, high)))
    return trees


def thresholds(table: DataFrame, trees: list, precision: float, least: int) -> list[float]:
    """For each kind the lowest margin from which on the candidates of ``table`` reach the precision; infinite if fewer than ``least`` positive ones do."""
    scored = table.groupBy("kind", F.expr(margin_sql(trees)).alias("margin")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()
    chosen = [math.inf] * len(KINDS)
    for kind in range(len(KINDS)):
        pos = neg = 0
        for r in sorted((r for r in scored if r["kind"] == kind), key=lambda r: -r["margin"]):
            pos, neg = pos + r["pos"], neg + r["neg"]
            if pos >= least and pos >= precision * (pos + neg + 1):
                chosen[kind] = r["margin"] - 1e-9
    return chosen


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95, least: int = 20) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, base and added ones as kind:start:end.

    Positions count code points, ends are exclusive; spans follow kind, start and end. A candidate is added if its score reaches
    its kind's threshold, no base span overlaps it, and no overlapping candidate of its kind that qualifies is longer (or as long
    and earlier). A kind with fewer than ``least`` positive examples to choose a threshold from gets no added span.

    Null and empty texts have no spans, and the digest of the empty string. Every row is searched by itself, so repeated
    rows are alike; examples are counted over all rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = found(rows, "text")
    # bounded by the features' values
    table = checkpointed(examples(spans).coalesce(1))
    trees = boost(table.where("fold = 0"))
    cuts = thresholds(table.where("fold = 1"), trees, precision, least)
    usable = [k for k in range(len(KINDS)) if cuts[k] < math.inf]
    enough = " or ".join(f"(c.kind = {k} and {margin_sql(trees, 'c.')} >= {cuts[k]!r}D)" for k in usable) or "false"
    chosen = spans.withColumn("candidates", F.expr(f"array_distinct(transform(filter(candidates, c -> {enough}), c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end)))"))
    chosen = chosen.withColumn("candidates", F.expr("filter(candidates, c -> not exists(base, b -> b.start < c.end and c.start < b.end))"))
    better = "o.end - o.start > c.end - c.start or (o.end - o.start = c.end - c.start and o.start < c.start)"
    chosen = chosen.withColumn("added", F.expr(f"filter(candidates, c -> not exists(candidates, o -> o.kind = c.kind and o.start < c.end and c.start < o.end and ({better})))"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    written = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return chosen.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("array_sort(array_union(base, added))").alias("spans"))
