"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed unigrams, bigrams and one- and two-word skip-grams
of a text, lower-cased in ASCII. Per-coordinate learning rates and L1 shrinkage
leave few non-zero weights, which are broadcast for scoring: at most
``2**bits`` pairs of a 4-byte index and a 4-byte weight (8 MiB at 20 bits),
whatever the corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K


@dataclass(frozen=True)
class Ftrl:
    """Parameters. max_rows, max_bytes: the most labelled rows, and bytes of their texts, that are used to fit, taken by the hash of their id. positive: weight of a row with label 1."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 0.0
    epochs: int = 6
    positive: float = 4.0
    max_rows: int = 12_000
    max_bytes: int = 48 << 20
    seed: int = 7


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: (distance of the second word, salt): 0 is the unigram, 1 the bigram, 2 and 3 skip-grams.
_GRAMS = ((0, 0x51ED270B), (1, 0xA0761D65), (2, 0xE7037ED1), (3, 0x8EBC6AF1))


def features(data, offsets, bits):
    """(document index, feature index) of every n-gram and skip-gram occurrence, gram by gram."""
    data = _LOWER[data]
    alone = K.space(data) | ((data < 48) | ((data > 57) & (data < 97)) | ((data > 122) & (data < 128)))
    docs, starts, ends = K.spans(~alone, offsets)
    words = K.span_hashes(data, starts, ends)
    shift = np.uint64(64 - bits)
    for gap, salt in _GRAMS:
        if gap == 0:
            yield docs, (K.mix(words + np.uint64(salt)) >> shift).astype(np.int64)
        elif len(words) > gap:
            same = docs[:-gap] == docs[gap:]
            pair = words[:-gap][same] * np.uint64(0x9FB21C651E98DF25) + words[gap:][same] * np.uint64(0xD6E8FEB86659FD93)
            yield docs[:-gap][same], (K.mix(pair + np.uint64(salt)) >> shift).astype(np.int64)


def _example_batches(bits):
    @K.tidy
    def run(batches):
        for rows, data, offsets in K.chunks(batches, "text"):
            pairs = [np.unique(d * (1 << bits) + f) for d, f in features(data, offsets, bits)]
            key = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            at = np.searchsorted(key, np.arange(len(offsets)) << bits)
            values = pa.array((key & ((1 << bits) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)], ["doc_id", "label", "features"])

    return run


def fit_examples(examples, ftrl: Ftrl):
    """Weights of FTRL-proximal after the given epochs over (label, feature indices) pairs, in a seeded order."""
    z, n = np.zeros(1 << ftrl.bits), np.zeros(1 << ftrl.bits)
    order = np.random.default_rng(ftrl.seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= ftrl.l1, 0.0, -(zi - np.sign(zi) * ftrl.l1) / ((ftrl.beta + np.sqrt(n[i])) / ftrl.alpha + ftrl.l2))

    bias_z = bias_n = 0.0
    for _ in range(ftrl.epochs):
        for k in order.permutation(len(examples)):
            y, i = examples[k]
            w = weights(i)
            b = -bias_z / ((ftrl.beta + bias_n**0.5) / ftrl.alpha + ftrl.l2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y) * (ftrl.positive if y else 1.0)
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ftrl.alpha
            z[i] += g - step * w
            n[i] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ftrl.alpha * b
            bias_n += g * g
    every = weights(np.arange(1 << ftrl.bits))
    index = np.flatnonzero(every)
    return index.astype(np.int32), every[index].astype(np.float32), float(-bias_z / ((ftrl.beta + bias_n**0.5) / ftrl.alpha + ftrl.l2))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, ftrl: Ftrl = Ftrl()):
    """Sparse weights (indices, values, bias) learnt from the labelled documents.

    ``labels`` has doc_id and label; a document's repeated labels count as 1 if one
    is 1; rows with a null id or label are left out. ``learn`` (over doc_id) says
    which rows may be learnt from. At most about ``max_rows`` rows are used, those
    with the smallest id hashes, and of these in that order all whose whole texts still fit into
    ``max_bytes``. This is the only bounded sample here: neither the fitted weights nor what is sent
    to the driver grows with the corpus or its texts. Null and empty texts are examples without a feature. No
    usable label: no weights and a score of 0.5 everywhere. Ties in the hash go by id; rows with one id all count.
    """
    chosen = labels.where("doc_id is not null and label is not null")
    if learn is not None:
        chosen = chosen.where(learn)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    total = chosen.count()
    if total > ftrl.max_rows:
        share = int(ftrl.max_rows / total * (1 << 31))
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(ftrl.seed)), F.lit(1 << 31)) < share)
    # the sample is bounded by max_rows, so its ids (16 bytes a row) may be broadcast
    turn = F.xxhash64("doc_id", F.lit(ftrl.seed)).alias("turn")
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "label").agg(F.sum("bytes").alias("bytes")).select("doc_id", "label", "bytes", turn)
    left, fitting = ftrl.max_bytes, []
    for row in sorted(sizes.collect(), key=lambda r: (r["turn"], r["doc_id"])):
        if row["bytes"] <= left:
            left -= row["bytes"]
            fitting.append((row["doc_id"], row["label"]))
    chosen = docs.sparkSession.createDataFrame(fitting, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = sample.select("doc_id", "label", "text").mapInArrow(_example_batches(ftrl.bits), "doc_id long, label int, features array<int>").toArrow()
    examples, batch, lists, flat = [], None, None, None
    for batch in rows.to_batches():
        # views of the collected batches, not a second copy of them
        lists, label = batch.column("features"), batch.column("label").to_numpy()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        examples += [(i, float(y), flat[a:b]) for i, y, a, b in zip(batch.column("doc_id").to_pylist(), label, at[:-1], at[1:], strict=True)]
    examples = [x[1:] for x in sorted(examples, key=lambda x: x[0])]
    model = fit_examples(examples, ftrl)
    del rows, examples, batch, lists, flat
    pa.default_memory_pool().release_unused()
    return model


def _margins(model, bits):
    """A function of a chunk's bytes that gives its documents' scores."""
    index, values, bias = model
    dense = np.zeros(1 << bits, np.float32)
    dense[index] = values

    def run(data, offsets):
        found = []
        for d, f in features(data, offsets, bits):
            hit = dense[f] != 0
            found.append((d[hit] << bits) + f[hit])
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        margin = bias + np.bincount(key >> bits, dense[key & ((1 << bits) - 1)], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

    return run


def score(docs: DataFrame, model, bits: int = Ftrl.bits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row. Null or empty text: the score of the bias alone.

    Rows are mapped one by one, so repeated rows and ids keep their own scores, and
    columns other than the two named don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches):
        scores = _margins(shared.value, bits)
        for rows, data, offsets in K.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(data, offsets))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model, threshold: float = 0.7, bits: int = Ftrl.bits) -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches):
        scores = _margins(shared.value, bits)
        for rows, data, offsets in K.chunks(batches, "text"):
            yield rows.filter(pa.array(scores(data, offsets) < threshold))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, ftrl: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row, learnt where held_out is false.

    Null ids count as held out. Rows are scored one by one: see ``score``.
    """
    model = fit(docs, labels, ~held_out, ftrl)
    return score(docs, model, ftrl.bits).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
