"""Line dedup: repeated runs of lines, from ranks by distributed prefix doubling, without completing the suffix array.

Lines that hold a word are numbered in sorted order, and the corpus is a sequence of these
numbers for each document. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines:
each round sorts the distinct pairs of ranks and numbers them. Ranks of length 2**j
name the intervals of the suffix array whose longest common prefix is at least 2**j
lines; two overlapping ranks name the interval of any length between. Only suffixes whose
lines all repeat stay in the rounds.

A run is repeated if it has at least ``min_words`` words. For each position the shortest such
run that starts there, and the shortest that ends there, is looked up in its interval:
if the interval's first suffix is earlier and does not overlap it, the run is a later copy.
These runs together cover exactly the later copies of all maximal repeated runs,
so rounds are needed only up to log2(min_words), however long the runs are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .graph import checkpointed

MIN_WORDS = 50
KEY = ["doc_id", "tkey"]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), pos (\\n-separated, from 0), two hashes and the word count of every line with a word.

    Lines are compared without the white space at their ends.
    """

    @K.tidy
    def run(batches):
        for part, data, offsets in K.chunks(batches, "text"):
            of, starts, ends = K.line_spans(data, offsets)
            pos = np.arange(len(of)) - np.searchsorted(of, of, "left")
            blank = K.space(data)
            filled = np.concatenate([[0], np.cumsum(~blank)])
            full = np.flatnonzero(filled[ends] > filled[starts])
            of, starts, ends, pos = of[full], starts[full], ends[full], pos[full]
            solid = np.flatnonzero(~blank)
            starts, ends = solid[filled[starts]], solid[filled[ends] - 1] + 1
            first = ~blank
            first[1:] &= blank[:-1]
            at = offsets[:-1][offsets[:-1] < len(data)]
            first[at] = ~blank[at]
            words = np.concatenate([[0], np.cumsum(first)])
            h = K.span_hashes(data, starts, ends)
            g = K.span_hashes(data ^ np.uint8(0x5A), starts, ends)
            keys = [part.column(c).take(pa.array(of)) for c in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pos.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array((words[ends] - words[starts]).astype(np.int32))], [*KEY, "pos", "h", "g", "words"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").where("text is not null and doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, tkey long, pos int, h long, g long, words int")


def _numbered(keys: DataFrame) -> DataFrame:
    """Distinct ``keys`` (two columns, renamed k1 and k2) with a rank that follows their order."""
    pairs = keys.toDF("k1", "k2").distinct().orderBy("k1", "k2")
    ranked = checkpointed(pairs.withColumn("name", F.monotonically_increasing_id()))
    # without its partitioning, so that joins may split hot keys
    return ranked.withColumn("k1", F.col("k1") + F.lit(0))


def _stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """Runs of lines that all repeat somewhere, with at least ``min_words`` words in all.

    idx numbers a document's lines that hold a word, run its stretches, upto sums the words
    of a stretch; rank is the line's number in sorted order.
    """
    # a few numbers a line, read by the count and by the join
    every = checkpointed(lines(docs))
    seen = every.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    numbers = _numbered(seen.select("h", "g"))
    known = every.join(numbers, (every["h"] == numbers["k1"]) & (every["g"] == numbers["k2"]), "left")
    place = Window.partitionBy(*KEY).orderBy("pos")
    # rows that repeat with the same id and text are one document
    once = known.withColumn("again", F.row_number().over(Window.partitionBy(*KEY, "pos").orderBy("words"))).where("again = 1")
    runs = once.withColumn("idx", F.row_number().over(place)).withColumn("run", F.sum(F.col("name").isNull().cast("int")).over(place)).where("name is not null")
    kept = runs.withColumn("all_words", F.sum("words").over(Window.partitionBy(*KEY, "run"))).where(F.col("all_words") >= min_words)
    upto = F.sum("words").over(Window.partitionBy(*KEY, "run").orderBy("idx"))
    return checkpointed(kept.select(*KEY, "run", "idx", "pos", "words", upto.alias("upto"), F.col("name").alias("rank")))


def _windows(base: DataFrame, min_words: int) -> DataFrame:
    """Distinct (document, start, len): the shortest run of min_words words from each line on, and up to each line."""
    packed = base.groupBy(*KEY, "run").agg(F.sort_array(F.collect_list(F.struct("idx", "upto", "words"))).alias("seq"))

    @K.tidy
    def shortest(batches):
        for batch in batches:
            counts, starts, lens = [], [], []
            for seq in batch.column("seq"):
                idx, upto, words = (v.to_numpy() for v in seq.values.flatten())
                before = upto - words
                end = np.searchsorted(upto, before + min_words, "left")
                ok = np.flatnonzero(end < len(upto))
                begin = np.searchsorted(before, upto - min_words, "right") - 1
                back = np.flatnonzero(begin >= 0)
                pairs = np.unique(np.concatenate([np.stack([ok, end[ok]], 1), np.stack([begin[back], back], 1)]), axis=0)
                counts.append(len(pairs))
                starts.append(idx[pairs[:, 0]])
                lens.append(pairs[:, 1] - pairs[:, 0] + 1)
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in KEY], flat(starts), flat(lens)], [*KEY, "start", "len"])

    return packed.select(*KEY, "seq").mapInArrow(shortest, "doc_id long, tkey long, start int, len int")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tkey and gone (sorted positions of the deleted lines) of every document that loses a line."""
    base = _stretches(docs, min_words)
    windows = checkpointed(_windows(base, min_words))
    longest = windows.agg(F.max("len")).head()[0] or 0
    ranks = base.select(*KEY, "run", "idx", "rank")
    named = None
    for j in range(longest.bit_length()):
        if j:
            # the halves of 2**j lines: this line's rank and that of the line where the second half starts
            ahead = F.lead("rank", 1 << (j - 1)).over(Window.partitionBy(*KEY, "run").orderBy("idx"))
            pairs = ranks.withColumn("ahead", ahead).where("ahead is not null")
            numbers = _numbered(pairs.select("rank", "ahead"))
            joined = pairs.join(numbers, (pairs["rank"] == numbers["k1"]) & (pairs["ahead"] == numbers["k2"]))
            ranks = checkpointed(joined.select(*KEY, "run", "idx", F.col("name").alias("rank")))
        level = windows.where((F.col("len") >= (1 << j)) & (F.col("len") < (2 << j))).withColumn("last", F.col("start") + F.col("len") - (1 << j))
        heads = ranks.select(*KEY, F.col("idx").alias("start"), F.col("rank").alias("head"))
        tails = ranks.select(*KEY, F.col("idx").alias("last"), F.col("rank").alias("tail"))
        here = level.join(heads, [*KEY, "start"]).join(tails, [*KEY, "last"]).select(*KEY, "start", "len", "head", "tail")
        named = here if named is None else named.union(here)
    if named is None:
        return windows.select(*KEY, F.array(F.lit(0)).alias("gone")).limit(0)
    named = checkpointed(named)
    # an interval's first suffix; len tells the level too
    interval = ["head", "tail", "len"]
    first = named.groupBy(*interval).agg(F.min(F.struct(*KEY, "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select((F.col("head") + F.lit(0)).alias("head"), "tail", "len", "first")
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tkey") == F.col("tkey"))
    copy = F.when(same, F.col("first.start") + F.col("len") <= F.col("start")).otherwise(F.lit(True))
    copies = named.join(first, interval).where(copy)
    runs = copies.groupBy(*KEY).agg(F.collect_set(F.struct("start", "len")).alias("runs"))
    covered = runs.select(*KEY, F.explode(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["len"] - 1))))).alias("idx"))
    return covered.join(base.select(*KEY, "idx", "pos"), [*KEY, "idx"]).groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_gone")) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from text, and the lines and the deleted lines counted (long).

    ``counts`` names the two counts; columns of ``docs`` with these names are replaced, all others pass through.

    A run is one or more lines in a row that hold a word, with at least ``min_words`` words
    in all; its first copy, by doc_id and position, stays. Copies that overlap the first
    within one document are no later copies. Lines without a word are no part of
    a run and stay. Null ids or texts are left as they are; rows with one id and text
    are one document, and each keeps the same lines; a document may end up empty.
    """
    gone = later_copies(docs.select("doc_id", "text"), min_words).select(F.col("doc_id").alias("__line_id"), F.col("tkey").alias("__line_tkey"), F.col("gone").alias("__line_gone"))
    rows = docs.drop(*counts)
    joined = rows.join(gone, (rows["doc_id"] == gone["__line_id"]) & (F.xxhash64(rows["text"]) == gone["__line_tkey"]), "left").drop("__line_id", "__line_tkey")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns

    @K.tidy
    def run(batches):
        for batch in batches:
            texts, total, lost = [], [], []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("__line_gone").to_pylist(), strict=True):
                split = text.split("\n") if text is not None else []
                total.append(len(split))
                lost.append(len(cut or ()))
                if cut:
                    drop = set(cut)
                    text = "\n".join(x for k, x in enumerate(split) if k not in drop)
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*names, *counts])

    return joined.select(*names, "__line_gone").mapInArrow(run, f"{kinds}, `{counts[0]}` long, `{counts[1]}` long")
