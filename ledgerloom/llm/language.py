"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from a hash of its code point, so
that any alphabet is covered without a table. A trigram's vector binds (multiplies)
its letters' vectors, the first permuted twice and the second once; a document's
vector bundles (adds) those of its trigrams, and a language's prototype bundles its
documents' vectors, each scaled to length 1. Documents are compared with prototypes
by cosine. Memory is bounded: a prototype has ``DIM`` numbers, and there is one for
each language learnt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

DIM = 1024
#: Languages whose prototypes may be broadcast, 8 bytes a dimension each.
MAX_LANGS = 4096
_SPACE = 32


def letter_vectors(codes, dim=DIM):
    """Random vectors of +1 and -1, one for each code point."""
    words = K.mix(K.mix(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))[:, None] + np.arange(dim // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), dim // 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def folded(cp):
    """Lower-cased letters; one space stands for each run of other characters."""
    known, inverse = np.unique(cp, return_inverse=True)
    low = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else _SPACE for c in known], np.int64)
    return low[inverse]


def _trigrams(data, offsets):
    """Alphabet, document and index (in base len(alphabet)) of each trigram, and each document's letter count."""
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    start = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(start)])[offsets]
    low = folded(text) if len(text) else np.zeros(0, np.int64)
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    letters = np.bincount(docs[low != _SPACE], minlength=len(offsets) - 1)
    keep = np.ones(len(low), bool)
    if len(low):
        keep[1:] = (low[1:] != _SPACE) | (low[:-1] != _SPACE) | (docs[1:] != docs[:-1])
    low, docs = low[keep], docs[keep]
    alphabet, idx = np.unique(low, return_inverse=True)
    size = max(len(alphabet), 1)
    tri = (idx[:-2] * size + idx[1:-1]) * size + idx[2:] if len(idx) > 2 else np.zeros(0, np.int64)
    same = docs[:-2] == docs[2:] if len(idx) > 2 else np.zeros(0, bool)
    return alphabet, docs[: len(tri)][same], tri[same], letters


def bundles(data, offsets, dim=DIM):
    """A vector for each document, and its count of letters; texts under three characters have the zero vector."""
    alphabet, docs, tri, letters = _trigrams(data, offsets)
    n, size = len(offsets) - 1, max(len(alphabet), 1)
    out = np.zeros((n, dim), np.float32)
    if len(tri) == 0:
        return out, letters
    if size**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(tri, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[used] = np.arange(len(used))
        tri = place[tri]
    else:
        used, tri = np.unique(tri, return_inverse=True)
    base = letter_vectors(alphabet, dim)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    step = 4096
    for lo in range(0, len(used), step):
        part = used[lo : lo + step]
        bound = (twice[part // size**2] * once[part // size % size] * base[part % size]).astype(np.float32)
        here = (tri >= lo) & (tri < lo + step)
        for first in range(0, n, 512):
            rows = here & (docs >= first) & (docs < first + 512) if n > 512 else here
            width = min(512, n - first)
            counts = np.bincount((docs[rows] - first) * len(part) + tri[rows] - lo, minlength=width * len(part)).astype(np.float32)
            out[first : first + width] += counts.reshape(width, len(part)) @ bound
    return out, letters


def _unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def prototypes(docs: DataFrame, max_rows: int = 4000, dim: int = DIM, seed: int = 11) -> list[tuple[str, np.ndarray]]:
    """A vector for each non-null ``lang`` of (doc_id, text, lang).

    The sample is bounded: about ``max_rows`` documents of each language, those with
    the smallest id hashes; their whole texts are bundled. What comes to the
    driver is one vector a language.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_rows)) / F.count("*")).alias("share"))
    taken = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) <= F.col("share") * float(1 << 31))

    @K.tidy
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for part, data, offsets in K.chunks(batches, "text"):
            vectors, _ = bundles(data, offsets, dim)
            vectors = _unit(vectors)
            langs = np.asarray(part.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0, dtype=np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64()))], ["lang", "v"])

    parts = taken.select("lang", "text").mapInArrow(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    summed = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    table = summed.select("lang", "v.x").orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(table) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages are too many to broadcast")
    return [(r[0], np.asarray(r[1])) for r in table]


def identify(docs: DataFrame, learnt: list[tuple[str, np.ndarray]], dim: int = DIM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; each text is read whole.

    score is the cosine to the nearest prototype, at least 0. Null text, text without a
    letter, or no prototype: ``und`` and 0. Equal cosines: the first language by name.
    """
    names = [x for x, _ in learnt]
    shared = docs.sparkSession.sparkContext.broadcast(_unit(np.array([v for _, v in learnt])).astype(np.float32) if learnt else None)

    @K.tidy
    def run(batches):
        for part, data, offsets in K.chunks(batches, "text"):
            vectors, letters = bundles(data, offsets, dim)
            if names:
                cosines = _unit(vectors) @ shared.value.T
                best, top = cosines.argmax(1), np.clip(cosines.max(1), 0, 1)
            else:
                best, top, letters = np.zeros(len(letters), int), np.zeros(len(letters)), letters * 0
            langs = pa.array([names[b] if n else "und" for b, n in zip(best, letters, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), langs, pa.array(np.where(letters > 0, top, 0.0).astype(np.float64))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predict(docs: DataFrame, held_out: Column, max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learnt where held_out is false (null ids count as held out)."""
    learnt = prototypes(docs.where(~F.coalesce(held_out, F.lit(True))), max_rows)
    return identify(docs, learnt).select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), "lang_pred", "score")
