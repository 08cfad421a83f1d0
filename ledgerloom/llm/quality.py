"""Quality rules with risk-controlled thresholds.

Each rule compares one ratio of a text with a cutoff. Labelled documents that pass the base rules
decide the cutoffs, stratum by stratum. Half of them, by a hash of the id, propose a ladder of
cutoffs for all rules together, from strict to bold. The other half, the holdout, is read
once: for the steps of the ladder in order, an exact binomial test asks whether the share of good documents
that *any* rule rejects is at most ``alpha``, and the first step that fails ends the climb. Testing in a fixed
order needs no correction for the steps; strata are corrected for by Bonferroni (``delta`` over their
number). So with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to all
rules together. Of the certified steps the one is used that catches most bad documents, less ``price`` for each good
one; a stratum with nothing certified or useful rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import checkpointed

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The rules' ratios, and the largest value of each grid.
RULES = {"symbols": 0.5, "dup_lines": 1.0, "repeats": 1.0, "upper": 1.0, "word_length": 20.0}
GRID = 40
#: Steps of the ladder, and strata up to which their cutoffs are broadcast.
STEPS, MAX_STRATA = 20, 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.03
    delta: float = 0.05
    price: float = 20.0


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The base counts, n_lines and n_upper of every row's whole text, with doc_id and the columns in ``keep``.

    Words are runs of characters other than space and \\t-\\r; null text counts as
    empty, and all its counts are 0.
    """

    @K.tidy
    def run(batches):
        for part, data, offsets in K.chunks(batches, "text"):
            n = len(offsets) - 1
            blank = K.space(data)
            docs_of, starts, ends = K.spans(~blank, offsets)
            lead = (data & 0xC0) != 0x80
            accented = np.zeros(len(data), bool)
            if len(data) > 1:
                accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            line_doc, line_start, line_end = K.line_spans(data, offsets)
            filled = np.concatenate([[0], np.cumsum(~blank)])
            full = filled[line_end] > filled[line_start]
            key = K.mix(K.span_hashes(data, line_start[full], line_end[full]) + K.mix(line_doc[full].astype(np.uint64)))
            _, first = np.unique(key, return_index=True)
            lines = np.bincount(line_doc[full], minlength=n)
            words = K.span_hashes(data, starts, ends)
            again = np.zeros(len(words), bool)
            if len(words) > 2:
                same = np.flatnonzero(docs_of[:-2] == docs_of[2:])
                window = words[:-2] * np.uint64(0x9FB21C651E98DF25) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9)
                _, inverse, counts = np.unique(K.mix(window[same] + K.mix(docs_of[same].astype(np.uint64))), return_inverse=True, return_counts=True)
                hit = same[counts[inverse] > 1]
                for k in range(3):
                    again[hit + k] = True
            columns = {
                "n_words": np.bincount(docs_of, minlength=n),
                "word_chars": K.per_document(lead & ~blank, offsets),
                "n_symbols": K.per_document(_SYMBOL[data], offsets),
                "n_dup_lines": lines - np.bincount(line_doc[full][first], minlength=n),
                "n_repeat_words": np.bincount(docs_of[again], minlength=n),
                "n_lines": lines,
                "n_upper": K.per_document(((data >= 65) & (data <= 90)) | accented, offsets),
            }
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", *keep)] + [pa.array(v.astype(np.int64)) for v in columns.values()], ["doc_id", *keep, *columns])

    head = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema if f.name != "text")
    return head.mapInArrow(run, kinds + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")


def ratios() -> dict:
    """Each rule's ratio as a column over ``signals``; 0 where the denominator is 0."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"), "upper": over("n_upper", "word_chars"), "word_length": over("word_chars", "n_words")}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed term by term; terms under 1e-300 of the largest are left out."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    low = max(0, int(min(k, n * p) - 40 * math.sqrt(n * p * (1 - p))) - 40)
    at = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    i = np.arange(low, k, dtype=float)
    logs = at + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    return float(min(1.0, np.exp(logs - logs.max()).sum() * math.exp(logs.max())))


def _from_above(counts: pd.DataFrame, at: str, size: int):
    """Good and bad documents at each value of ``at``, summed from the largest value down."""
    out = []
    for kind in ("good", "bad"):
        total = np.zeros(size)
        np.add.at(total, counts[at].to_numpy(), counts[kind].to_numpy())
        out.append(total[::-1].cumsum()[::-1])
    return out


def ladder(bins: pd.DataFrame, risk: Risk = Risk()) -> list[int]:
    """A rule's cutoff at each of STEPS steps, from its counts (bin, good, bad); GRID + 1 rejects nothing.

    Bin b holds ratios in (b, b + 1] grid steps; a cutoff at b rejects the bins from b on. Step t may lose t / STEPS
    of ``alpha`` of the good documents; of such cutoffs the most valuable is taken, of equal ones the highest. So
    cutoffs never rise from step to step.
    """
    lost, caught = _from_above(bins, "bin", GRID + 1)
    cuts, best, gain = [], GRID + 1, 0.0
    b = GRID
    for t in range(1, STEPS + 1):
        while b > 0 and lost[b] <= risk.alpha * t / STEPS * lost[0]:
            if caught[b] - risk.price * lost[b] > gain:
                best, gain = b, caught[b] - risk.price * lost[b]
            b -= 1
        cuts.append(best)
    return cuts


def certified(levels: pd.DataFrame, strata: int, risk: Risk = Risk()) -> int:
    """The step to use, from the holdout's counts (level, good, bad), where level is the first step that rejects; 0: none."""
    good, bad = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    np.add.at(good, levels["level"].to_numpy(), levels["good"].to_numpy())
    np.add.at(bad, levels["level"].to_numpy(), levels["bad"].to_numpy())
    n, lost, caught = int(good.sum()), good.cumsum(), bad.cumsum()
    best, gain = 0, 0.0
    for t in range(1, STEPS + 1):
        if not n or binomial_tail(int(lost[t]), n, risk.alpha) > risk.delta / strata:
            break
        if caught[t] - risk.price * lost[t] > gain:
            best, gain = t, caught[t] - risk.price * lost[t]
    return best


def failed_base(min_words: int = 50, max_repeat: int = 50):
    """Under ``min_words`` words, or more than ``max_repeat`` percent of them repeat."""
    return (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words"))


def _in_strata(measured: DataFrame, stratum: str) -> DataFrame:
    return measured.withColumn("stratum", F.coalesce(F.col(stratum), F.lit(""))).withColumn("none", F.col(stratum).isNull())


def _beside(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """``rows`` with their stratum's row of a checkpointed ``table``, which is broadcast while it is small."""
    few = table.limit(MAX_STRATA + 1).count() <= MAX_STRATA
    return rows.join(F.broadcast(table) if few else table, ["stratum", "none"], how)


def bins() -> dict:
    """Each rule's grid bin, 0 to GRID, as a column over ``signals``."""
    of = ratios()
    at = lambda r: F.ceil(of[r] / F.lit(RULES[r] / GRID)) - 1
    return {r: F.least(F.lit(GRID), F.greatest(F.lit(0), at(r))).cast("int") for r in RULES}


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """stratum, none (the stratum is null) and each rule's cutoff as a grid bin, from labels (doc_id, good: 1 or 0).

    A cutoff rejects its bin and those above, GRID + 1 nothing; a stratum without a row rejects nothing. Repeated
    labels of a document count as good if one is, and its rows as one trial in a stratum; null labels and ids are left out. Only counts
    leave the rows: by stratum, rule and grid point for the ladders, by stratum and step for the
    holdout; each stratum is decided in its own small group.
    """
    known = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    of, names = bins(), list(RULES)
    rows = _in_strata(measured.where(~failed_base()), stratum).join(known, "doc_id")
    half = F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2))
    # a document is one trial, however many rows have its id: by the highest bin of each rule
    once = rows.groupBy("stratum", "none", "doc_id").agg(F.max("good").alias("good"), *[F.max(of[r]).alias(f"bin_{r}") for r in names])
    labelled = checkpointed(once.select("stratum", "none", half.alias("half"), "good", *[f"bin_{r}" for r in names]))
    tally = [F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")]
    at = F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in names]))
    counted = labelled.where("half = 0").select("stratum", "none", "good", at).groupBy("stratum", "none", "rule", "bin").agg(*tally)

    def climb(part: pd.DataFrame) -> pd.DataFrame:
        steps = {f"cuts_{r}": [ladder(part[part["rule"] == r], risk)] for r in names}
        return pd.DataFrame({"stratum": part["stratum"].iloc[:1].to_list(), "none": part["none"].iloc[:1].to_list(), **steps})

    kinds = ", ".join(f"cuts_{r} array<int>" for r in names)
    ladders = checkpointed(counted.groupBy("stratum", "none").applyInPandas(climb, f"stratum string, none boolean, {kinds}"))
    strata = max(1, ladders.count())
    above = lambda r: F.size(F.filter(f"cuts_{r}", lambda c: c > F.col(f"bin_{r}")))
    level = F.least(*map(above, names)) + 1
    held = _beside(labelled.where("half = 1"), ladders, "inner").groupBy("stratum", "none", level.alias("level")).agg(*tally)

    def certify(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": part["stratum"].iloc[:1], "none": part["none"].iloc[:1], "used": [certified(part, strata, risk)]})

    used = held.groupBy("stratum", "none").applyInPandas(certify, "stratum string, none boolean, used int").where("used > 0")
    cuts = [F.element_at(f"cuts_{r}", F.col("used")).alias(f"cut_{r}") for r in names]
    return ladders.join(used, ["stratum", "none"]).select("stratum", "none", *cuts)


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed and kept: the base holds and no rule's bin reaches its stratum's cutoff."""
    of = bins()
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(of[r] >= F.col(f"cut_{r}"), F.lit(False))
    joined = _beside(_in_strata(measured, stratum), checkpointed(cuts), "left")
    return joined.select("doc_id", *BASE, failed_base().alias("base_failed"), (~failed_base() & ~over).alias("kept"))


def rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk()) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    Null and empty texts have no words and fail the base. Rows with a null or repeated id are judged one by one;
    a label counts for every row of its id. A null stratum is one of its own. Other columns are ignored, whatever
    their names. Without labels, or on an empty table, no cutoff is set.
    """
    docs = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("lang"))
    # a few numbers a document, read by both the calibration and the verdict
    measured = checkpointed(signals(docs))
    return judge(measured, cutoffs(measured, labels.select("doc_id", "good"), "lang", risk), "lang")
