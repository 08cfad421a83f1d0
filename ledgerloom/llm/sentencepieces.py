"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed into a normaliser, the metaspace marker, scored pieces
(unigram scores, or the merges that BPE scores imply) and byte fallback. A text is cut
where no piece can reach across, which is checked against the vocabulary; distinct
cuts of a batch are encoded once, in multithreaded batches, and held against
the sentencepiece library. Everything is a map over rows; the model (its size is
checked against ``MAX_MODEL_BYTES``) is broadcast.
"""

from __future__ import annotations

import io
import os
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

MAX_MODEL_BYTES = 32 << 20
#: Bytes of text that are encoded at once (a longer text by itself), and distinct cuts that go to the libraries at once:
#: both keep what a task holds small, whatever the table holds. A task remembers the cuts of the chunk before, no others.
CHUNK, AT_ONCE = 1 << 21, 1 << 13
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def load(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, from a path of the driver or one of a store that Spark reads."""
    if "://" in path:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    else:
        with open(path, "rb") as f:
            data = f.read()
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"a model of {len(data)} bytes is too large to broadcast")
    return data


def fields(message: bytes):
    """(number, value) of each field of a serialised protobuf message."""
    stream = io.BytesIO(message)

    def varint():
        value = shift = 0
        while True:
            byte = stream.read(1)
            if not byte:
                raise EOFError
            value |= (byte[0] & 127) << shift
            shift += 7
            if byte[0] < 128:
                return value

    while stream.tell() < len(message):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            yield key >> 3, stream.read({1: 8, 5: 4}[wire] if wire != 2 else varint())


class Model:
    """What the protobuf holds: pieces with scores and kinds, and the normaliser's settings."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.algorithm, self.fallback, self.unk = UNIGRAM, False, 0
        self.charsmap, self.prefix, self.collapse, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
                self.algorithm, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(fields(value))
                self.charsmap, self.prefix = norm.get(2, b""), bool(norm.get(3, 1))
                self.collapse, self.escape = bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        if not self.escape:
            raise ValueError("models without the metaspace marker aren't supported")

    def merges(self):
        """Pairs of pieces by the score of what they make, highest first."""
        index = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        pairs = [(-self.scores[i], index[p[:k]], index[p[k:]]) for p, i in index.items() for k in range(1, len(p)) if p[:k] in index and p[k:] in index]
        return [(self.pieces[a], self.pieces[b]) for _, a, b in sorted(pairs)]

    def separate(self):
        """Whether a marker after another character, and a line feed, always stand at a border of pieces."""
        return not any(k == NORMAL and (MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1) for p, k in zip(self.pieces, self.kinds, strict=True)) and USER not in self.kinds

    def normalizer(self):
        """The steps before the marker is put in, or None."""
        from tokenizers import Regex, normalizers

        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.collapse:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        return normalizers.Sequence(steps) if steps else None

    def tokenizer(self):
        """The rebuilt tokenizer, for texts in which the marker stands for spaces."""
        from tokenizers import AddedToken, Tokenizer, models

        if self.algorithm == UNIGRAM:
            core = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unk, self.fallback)
        elif self.algorithm == BPE:
            core = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=self.fallback)
        else:
            raise ValueError(f"model type {self.algorithm} isn't supported")
        made = Tokenizer(core)
        made.add_tokens([AddedToken(p, normalized=False) for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER])
        return made

    def normalize(self, text: str) -> str:
        """A text as its pieces spell it."""
        steps = self.normalizer()
        text = steps.normalize_str(text) if steps is not None else text
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def bytes_table(self):
        """Each id's bytes in a decoded text: start offsets and the bytes end to end."""
        spelled = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            spelled.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        return at, np.frombuffer(b"".join(spelled), np.uint8)


def ragged(starts, lengths):
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


class Codec:
    """Encodes and decodes batches; remembers the last chunk's distinct cuts."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = Model(data)
        self.core = self.model.tokenizer()
        self.steps, self.separate = self.model.normalizer(), self.model.separate()
        # the library's own processor without its prefix: the settings of a message given twice merge
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x04\x18\x00\x20\x00")
        self.table = self.model.bytes_table()
        self.forget()

    def forget(self):
        self.known, self.same = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encoded(self, texts):
        """ids of the texts end to end, their numbers, and whether the library gives the same."""
        found = [e.ids for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]
        same = [a == b for a, b in zip(found, self.own.encode(texts, num_threads=1), strict=True)]
        size = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size, np.array(same, bool)

    def _learn(self, cuts, spell):
        """Remember ``cuts`` (sorted hashes) and nothing else; ``spell`` gives the texts of those at the positions it gets."""
        slot = np.minimum(np.searchsorted(self.known, cuts), max(0, len(self.known) - 1))
        old = self.known[slot] == cuts if len(self.known) else np.zeros(len(cuts), bool)
        new = np.flatnonzero(~old)
        parts = [self._encoded(spell(new[lo : lo + AT_ONCE])) for lo in range(0, len(new), AT_ONCE)]
        size, same = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), bool)
        size[old], same[old] = self.size[slot[old]], self.same[slot[old]]
        for k, lo in enumerate(range(0, len(new), AT_ONCE)):
            size[new[lo : lo + AT_ONCE]], same[new[lo : lo + AT_ONCE]] = parts[k][1:]
        at = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        ids[ragged(at[old], size[old])] = self.ids[ragged(self.at[slot[old]], size[old])]
        if parts:
            ids[ragged(at[new], size[new])] = np.concatenate([p[0] for p in parts])
        self.known, self.at, self.size, self.same, self.ids = cuts, at, size, same, ids

    def encode(self, data, offsets):
        """ids of all texts end to end, their offsets, and whether every cut has the library's own ids."""
        if self.steps is not None:
            texts = [self.steps.normalize_str(data[a:b].tobytes().decode("utf-8", "replace")).encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(data)
        start = np.zeros(n, bool)
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if self.separate and n:
            space, feed = data == 32, data == 10
            start[1:] |= (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)[: len(starts)]
        docs = np.searchsorted(offsets, starts, "right") - 1
        first = np.zeros(len(starts), bool)
        first[np.searchsorted(starts, offsets[:-1][offsets[:-1] < offsets[1:]])] = self.model.prefix
        hashes = K.span_hashes(data, starts, ends)
        hashes = np.where(first, K.mix(hashes), hashes)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        mark = lambda w: MARK if first[w] else ""
        self._learn(distinct, lambda at: [mark(w) + raw[starts[w] : ends[w]].decode("utf-8", "replace").replace(" ", MARK) for w in where[at]])
        slot = inverse
        size = self.size[slot]
        ids = self.ids[ragged(self.at[slot], size)]
        count = np.bincount(docs, size, minlength=len(offsets) - 1).astype(np.int64)
        odd = np.bincount(docs[~self.same[slot]], minlength=len(offsets) - 1)
        return ids, np.concatenate([[0], np.cumsum(count)]), odd == 0

    def decode(self, ids, offsets):
        """The texts of id lists, as bytes end to end with their offsets."""
        at, spelled = self.table
        size = (at[1:] - at[:-1])[ids]
        data = spelled[ragged(at[ids], size)]
        cuts = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.model.prefix and len(data):
            drop = cuts[:-1][(cuts[:-1] < cuts[1:])]
            drop = drop[data[drop] == 32]
            keep = np.ones(len(data), bool)
            keep[drop] = False
            cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
            data = data[keep]
        return data, cuts


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep``, ids, n_tokens, parity and round_trip of every row's whole text.

    parity: the sentencepiece library gives the same ids. round_trip: the ids decode to the
    normalised text. Null and empty texts have no ids, and both hold. Rows are encoded
    one by one, so repeated rows are alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches):
        codec = Codec(shared.value, threads)
        for part, data, offsets in K.chunks(batches, "text", CHUNK):
            ids, at, parity = codec.encode(data, offsets)
            back, cuts = codec.decode(ids, at)
            if codec.steps is None and np.array_equal(cuts, offsets) and np.array_equal(back, data):
                trip = np.ones(len(parity), bool)
            else:
                whole, raw = back.tobytes(), data.tobytes()
                normal = lambda x: codec.steps.normalize_str(x.decode("utf-8", "replace")).encode() if codec.steps is not None else x
                trip = np.array([whole[cuts[i] : cuts[i + 1]] == normal(raw[offsets[i] : offsets[i + 1]]) for i in range(len(parity))], bool)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", *keep)], lists, pa.array(np.diff(at)), pa.array(parity), pa.array(trip)], ["doc_id", *keep, "ids", "n_tokens", "parity", "round_trip"])

    head = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema if f.name != "text")
    return head.mapInArrow(run, kinds + ", ids array<int>, n_tokens long, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row's ids; null ids give an empty text, bytes that aren't UTF-8 U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @K.tidy
    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            data, cuts = codec.decode(np.array([i for x in lists for i in x or ()], np.int64), at)
            raw = data.tobytes()
            texts = [raw[cuts[i] : cuts[i + 1]].decode("utf-8", "replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
