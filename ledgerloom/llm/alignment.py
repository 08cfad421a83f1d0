"""Alignment of two tokenizers' vocabularies over a corpus, by id-striped dense count matrices.

Both tokenizers encode the same bytes, a space and the text. A text is cut where both have a border whatever stands
around it; a task encodes every distinct piece once and keeps its groups and links. Documents leave a task as rows of digests,
links as lists of numbers of the batch's distinct id pairs, and the pairs themselves with the number of documents that
hold them. Pairs go to stripes by their A id; a stripe adds them up in a dense matrix of its A ids by all B ids
(``np.add.at``), whose row maxima give each A id's best B ids. The counts then return to the batches, where they meet
the links that were kept apart: neither links nor documents pass through the stripes.

A batch holds at most about ``PAIRS`` distinct pairs and ``BATCH_BYTES`` of text (or one longer text), a matrix
``STRIPE`` times the B vocabulary; both vocabularies' sizes are checked.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .graph import checkpointed
from .sentencepieces import Model, load, ragged

#: A ids of one stripe are those with the same remainder modulo the number of stripes.
STRIPE = 32
#: Matrix cells are bounded by STRIPE times the larger vocabulary allowed.
MAX_IDS = 1 << 18
CHUNK, BATCH_BYTES, PAIRS, KNOWN, AT_ONCE = 1 << 20, 1 << 26, 1 << 20, 1 << 18, 1 << 15
EMPTY = np.zeros(0, np.int64)
COLUMNS = "batch long, kind int, place long, doc_id {id}, numbers array<long>, body binary, digest string, counts array<long>"


def _bytes_of_a(text: str) -> list[bytes]:
    """Bytes of the byte-level vocabulary's ids, in order."""
    vocab = json.loads(text)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    spelled = [b""] * (max(vocab.values()) + 1)
    for piece, at in vocab.items():
        spelled[at] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return spelled


def _joined(parts: list[bytes]):
    """Starts, lengths and bytes of parts end to end."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.cumsum(size) - size, size, np.frombuffer(b"".join(parts), np.uint8)


def cuts(data: np.ndarray, offsets: np.ndarray, separate: bool) -> np.ndarray:
    """Starts of the pieces of texts end to end: where both tokenizers have a border.

    Before a space, and before a line feed, that follows a character which is no white space; after a line feed that stands alone. White
    space beyond ASCII is told by its first bytes; taking more characters for it only makes pieces longer.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if separate and n:
        solid = (data > 32) & (data < 127)
        wide = data >= 128
        # the last byte of a character whose first byte begins no white space: two bytes but not C2, four bytes, or three but not E1 to E3
        lead = np.where(data >= 192, data, 0)
        one, two, three = (np.concatenate([np.zeros(k, lead.dtype), lead[:-k]]) if n > k else np.zeros(n, lead.dtype) for k in (1, 2, 3))
        ends = wide & (((one >= 195) & (one < 224)) | (two >= 228) & (two < 240) | (three >= 240))
        before = np.concatenate([[False], (solid | ends)[:-1]])
        begins = solid | (data >= 195) & ~((data >= 225) & (data <= 227))
        after = np.concatenate([begins[1:], [False]])
        feed = data == 10
        start |= before & ((data == 32) | feed)
        start[1:] |= (feed & before & after)[:-1]
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(start)


class Aligner:
    """Encodes distinct pieces with both tokenizers; remembers at most about ``KNOWN`` of them."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        # without its prefix, which the texts bring: the settings of a message given twice merge
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model + b"\x1a\x04\x18\x00\x20\x00")
        model = Model(b_model)
        self.separate = model.separate() and not model.charsmap and not model.collapse
        at, spelled = model.bytes_table()
        # each side's start, number and bytes of what its ids spell, and the same of decimal ids
        self.spelled = [_joined(_bytes_of_a(a_json)), (at[:-1], np.diff(at), spelled)]
        self.n_b = len(model.pieces)
        self.decimals = _joined([str(k).encode() for k in range(max(self.n_b, len(self.spelled[0][0])))])
        self.forget()

    def forget(self):
        """Drop all pieces."""
        self.known, self.order = np.zeros(0, np.uint64), EMPTY
        self.groups: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.same, self.at, self.size, self.links = np.zeros(0, bool), EMPTY, EMPTY, EMPTY

    def _same(self, side, flat, owner, data, size):
        """Whether each piece's ids spell its bytes."""
        at, length, spelled = self.spelled[side]
        same = np.bincount(owner, length[flat], minlength=len(size)).astype(np.int64) == size
        kept = flat[same[owner]]
        inside = np.repeat(same, size)
        other = spelled[ragged(at[kept], length[kept])] != data[inside]
        return same & (np.bincount(np.repeat(np.arange(len(size)), size)[inside], other, minlength=len(size)) == 0)

    def learn(self, hashes, raw):
        """Encode new pieces: for each its groups as text, its numbers of ids, groups and links, its links and whether the bytes agree."""
        texts = [r.decode("utf-8", "replace") for r in raw]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = [[e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode(texts, num_threads=1)]
        numbers = [np.array([len(x) for x in side], np.int64) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, numbers, strict=True)]
        owner = [np.repeat(np.arange(len(raw)), n) for n in numbers]
        same = self._same(0, flat[0], owner[0], data, size) & self._same(1, flat[1], owner[1], data, size)
        for side in (0, 1):
            flat[side], owner[side] = flat[side][same[owner[side]]], owner[side][same[owner[side]]]
        # places in the agreeing pieces' bytes end to end
        length = [self.spelled[side][1][flat[side]] for side in (0, 1)]
        ends = [np.cumsum(n) for n in length]
        starts = [e - n for e, n in zip(ends, length, strict=True)]
        # ids of A and B whose bytes overlap; pieces meet at common borders, so none reaches over
        first = np.searchsorted(ends[1], starts[0], "right")
        reach = np.maximum(np.searchsorted(starts[1], ends[0], "left") - first, 0)
        pairs = np.repeat(flat[0], reach) * self.n_b + flat[1][ragged(first, reach)]
        shared = np.isin(ends[0], ends[1], assume_unique=True)
        common = ends[0][shared]
        # ids in the order of groups, A before B, and what stands after each
        place = np.concatenate([2 * np.searchsorted(common, ends[0], "left"), 2 * np.searchsorted(common, ends[1], "left") + 1])
        order = np.argsort(place, kind="stable")
        place, number = place[order], np.concatenate(flat)[order]
        step = np.diff(place, append=-9)
        after = np.where(step == 0, 44, np.where((step == 1) & (place % 2 == 0), 124, 59)).astype(np.uint8)
        at, digits, decimals = self.decimals
        width = digits[number]
        begin = np.cumsum(width + 1) - width - 1
        written = np.zeros(int((width + 1).sum()), np.uint8)
        written[ragged(begin, width)] = decimals[ragged(at[number], width)]
        written[begin + width] = after
        counts = np.stack([np.bincount(x, minlength=len(raw)) for x in (owner[0], owner[1], owner[0][shared], np.repeat(owner[0], reach))], 1).astype(np.int64)
        last = np.cumsum(counts[:, 0] + counts[:, 1])
        text = written.tobytes()
        bounds = np.concatenate([[0], begin + width + 1])
        from_, to = bounds[last - counts[:, 0] - counts[:, 1]], np.maximum(bounds[last] - 1, 0)
        links = counts[:, 3]
        self.at = np.concatenate([self.at, len(self.links) + np.cumsum(links) - links])
        self.links = np.concatenate([self.links, pairs])
        self.size, self.same, self.counts = np.concatenate([self.size, links]), np.concatenate([self.same, same]), np.concatenate([self.counts, counts])
        self.groups += [text[i:j] for i, j in zip(from_.tolist(), to.tolist(), strict=True)]
        self.known = np.concatenate([self.known, hashes])
        self.order = np.argsort(self.known, kind="stable")

    def slots(self, hashes, spell):
        """Where each hash's piece is kept; ``spell`` gives the bytes at the positions it gets."""
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KNOWN:
            self.forget()

        def find():
            at = np.minimum(np.searchsorted(self.known, distinct, sorter=self.order), max(0, len(self.known) - 1))
            spot = self.order[at] if len(self.order) else np.zeros(len(distinct), np.int64)
            return spot, self.known[spot] == distinct if len(self.known) else np.zeros(len(distinct), bool)

        spot, old = find()
        if not old.all():
            new, at = distinct[~old], where[~old]
            for lo in range(0, len(new), AT_ONCE):
                self.learn(new[lo : lo + AT_ONCE], spell(at[lo : lo + AT_ONCE]))
            spot, _ = find()
        return spot[inverse]

    def documents(self, data, offsets):
        """Of texts end to end (each with its space before it): numbers (n_a, n_b, n_groups, n_links), digests, and the links of all.

        Links come as document, pair and times, each pair of a document once.
        """
        docs = len(offsets) - 1
        starts = cuts(data, offsets, self.separate)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        owner = np.searchsorted(offsets, starts, "right") - 1
        raw = data.tobytes()
        slot = self.slots(K.span_hashes(data, starts, ends), lambda at: [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        # a text that is only its space is empty; where a piece's bytes differ the whole text has no tokens
        none = np.diff(offsets) <= 1
        none |= np.bincount(owner[~self.same[slot]], minlength=docs) > 0
        counts = np.stack([np.bincount(owner, self.counts[slot, c], minlength=docs) for c in range(4)], 1).astype(np.int64) if docs else np.zeros((0, 4), np.int64)
        counts[none] = 0
        limits = np.searchsorted(owner, np.arange(docs + 1))
        digests = ["" if none[k] else hashlib.sha256(b";".join([self.groups[s] for s in slot[limits[k] : limits[k + 1]].tolist()])).hexdigest() for k in range(docs)]
        live = ~none[owner]
        span = np.int64(len(self.known) + 1)
        code, times = np.unique(owner[live] * span + slot[live], return_counts=True)
        doc, piece = code // span, code % span
        size = self.size[piece]
        pair, doc, times = self.links[ragged(self.at[piece], size)], np.repeat(doc, size), np.repeat(times, size)
        order = np.lexsort((pair, doc))
        pair, doc, times = pair[order], doc[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        return counts, digests, (doc[head], pair[head], np.add.reduceat(times, head) if len(head) else EMPTY)


def _packed(doc, number, times) -> bytes:
    return pa.compress(np.concatenate([doc, number, times]).astype(np.int32).tobytes(), "zstd", asbytes=True) if len(doc) else b""


def _unpacked(body: bytes, n: int):
    flat = np.frombuffer(pa.decompress(body, n * 12, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)
    return flat.reshape(3, n).astype(np.int64)


def _encoded(docs: DataFrame, a_json: str, b_model: bytes, stripes: int) -> DataFrame:
    """Rows of ``COLUMNS``: per batch and stripe (kind 0, place: stripe) its pairs in counts and their documents in numbers, per
    chunk (kind 1) its links in body, per document (kind 2) its id, numbers and digest."""
    shared = docs.sparkSession.sparkContext.broadcast((a_json, b_model))
    kind = docs.schema["doc_id"].dataType
    ids = to_arrow_type(kind)
    names = ["batch", "kind", "place", "doc_id", "numbers", "body", "digest", "counts"]

    def rows(batch, kinds, place, doc_id=None, numbers=None, body=None, digest=None, counts=None):
        n = len(place)
        given = [pa.array(np.full(n, batch)), pa.array(np.full(n, kinds, np.int32)), pa.array(place)]
        given.append(doc_id if doc_id is not None else pa.nulls(n, ids))
        for value, sort in ((numbers, pa.list_(pa.int64())), (body, pa.binary()), (digest, pa.string()), (counts, pa.list_(pa.int64()))):
            given.append(pa.nulls(n, sort) if value is None else pa.array(value, sort) if isinstance(value, list) else value)
        return pa.RecordBatch.from_arrays(given, names)

    def lists(values, at):
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int64)))

    @K.tidy
    def run(batches):
        aligner = Aligner(*shared.value)
        n_b = aligner.n_b
        batch, turn = TaskContext.get().partitionId() << 32, 0
        pairs, held, read, place = EMPTY, EMPTY, 0, 0

        def flush():
            """The batch's links and pairs; a pair's number is its place in the order of stripes."""
            stripe = pairs // n_b % stripes
            order = np.argsort(stripe, kind="stable")
            number = np.zeros(len(pairs), np.int64)
            number[order] = np.arange(len(pairs))
            for first, distinct, doc, local, times in bodies:
                own = number[np.searchsorted(pairs, distinct)]
                yield rows(batch + turn, 1, np.array([first]), numbers=[[len(doc)]], body=[_packed(doc, own[local], times)])
            at = np.concatenate([[0], np.cumsum(np.bincount(stripe, minlength=stripes))])
            used = np.flatnonzero(np.diff(at))
            limits = np.concatenate([at[used], at[-1:]])
            for lo in range(0, len(used), 512):
                hi = min(lo + 512, len(used))
                cut = limits[lo : hi + 1]
                inner = order[cut[0] : cut[-1]]
                yield rows(batch + turn, 0, used[lo:hi], numbers=lists(held[inner], cut - cut[0]), counts=lists(pairs[inner], cut - cut[0]))

        def chunk(part, data, offsets):
            # a space before every text
            count = len(offsets) - 1
            longer = offsets + np.arange(count + 1)
            spaced = np.full(int(longer[-1]), 32, np.uint8)
            inside = np.ones(len(spaced), bool)
            inside[longer[:-1]] = False
            spaced[inside] = data
            return aligner.documents(spaced, longer)

        bodies = []
        for part, data, offsets in K.chunks(batches, "text", CHUNK):
            counts, digests, (doc, pair, times) = chunk(part, data, offsets)
            yield rows(batch + turn, 2, place + np.arange(part.num_rows), doc_id=part.column(part.schema.get_field_index("doc_id")), numbers=lists(counts.ravel(), np.arange(part.num_rows + 1) * 4), digest=digests)
            distinct, n_docs = np.unique(pair, return_counts=True)
            union = np.union1d(pairs, distinct)
            grown = np.zeros(len(union), np.int64)
            grown[np.searchsorted(union, pairs)] = held
            grown[np.searchsorted(union, distinct)] += n_docs
            pairs, held = union, grown
            # the pairs themselves until the batch's numbers are known, each chunk's as its own distinct ones
            bodies.append((place, distinct, doc, np.searchsorted(distinct, pair), times))
            place, read = place + part.num_rows, read + len(data)
            if len(pairs) > PAIRS or read > BATCH_BYTES:
                yield from flush()
                turn, pairs, held, read, place, bodies = turn + 1, EMPTY, EMPTY, 0, 0, []
        if place:
            yield from flush()

    return docs.mapInArrow(run, COLUMNS.format(id=kind.simpleString()))


def _stripes(pairs: DataFrame, n_b: int, stripes: int) -> DataFrame:
    """place (stripe), and the pairs found in it with their documents and whether they are their A id's best, as counts, numbers and best."""

    @K.tidy
    def run(batches):
        block, now, seen = np.zeros((STRIPE, n_b), np.int64), None, []

        def close():
            top = block.max(axis=1)
            row, b = np.nonzero(block)
            count = block[row, b]
            a = row * stripes + now
            return pa.RecordBatch.from_pydict({"place": pa.array([now], pa.int64()), "counts": pa.array([a * n_b + b], pa.list_(pa.int64())), "numbers": pa.array([count], pa.list_(pa.int64())), "best": pa.array([(count == top[row])], pa.list_(pa.bool_()))})

        for batch in batches:
            place = batch.column("place").to_numpy()
            for k in range(batch.num_rows):
                if place[k] != now:
                    if now is not None:
                        yield close()
                        block[:] = 0
                    now = int(place[k])
                pair = batch.column("counts")[k].values.to_numpy()
                np.add.at(block, (pair // n_b // stripes, pair % n_b), batch.column("numbers")[k].values.to_numpy())
        if now is not None:
            yield close()

    ordered = pairs.repartition("place").sortWithinPartitions("place")
    return ordered.mapInArrow(run, "place long, counts array<long>, numbers array<long>, best array<boolean>")


def _returned(pairs: DataFrame, striped: DataFrame) -> DataFrame:
    """For each batch and stripe (kind 0, place) the corpus-wide counts of its pairs, negative where they are no A id's best."""

    @K.tidy
    def run(batches):
        table = (EMPTY, EMPTY)
        for batch in batches:
            kind, keep, found = batch.column("kind").to_numpy(), [], []
            for k in range(batch.num_rows):
                pair, count = batch.column("counts")[k].values.to_numpy(), batch.column("numbers")[k].values.to_numpy()
                if kind[k] < 0:
                    table = (pair, count)
                else:
                    keep.append(k)
                    found.append(table[1][np.searchsorted(table[0], pair)])
            if keep:
                at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column("batch"), part.column("place"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(found)))], ["batch", "place", "counts"])

    signed = F.expr("zip_with(numbers, best, (n, b) -> if(b, n, -n))")
    tables = striped.select(F.lit(-1).cast("long").alias("batch"), F.lit(-1).alias("kind"), "place", "counts", signed.alias("numbers"))
    both = tables.union(pairs.select("batch", "kind", "place", "counts", "numbers"))
    ordered = both.repartition("place").sortWithinPartitions("place", "kind")
    return ordered.mapInArrow(run, "batch long, place long, counts array<long>")


def align(docs: DataFrame, a_json: str, b_model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of its whole text.

    A (a byte-level BPE of the tokenizers library, as JSON) encodes a space and the text, B (a sentencepiece model with a dummy prefix) the
    text. Where both have a token's end the text is cut into groups. Linked are an A and a B token whose bytes overlap; a pair of ids
    counts in how many rows it is linked. n_best counts the links whose count is the highest of their A id, count_sum adds the counts
    of all links. Null and empty texts, and those whose bytes a tokenizer doesn't give back, have zeros and an empty digest, and are
    in no count. Repeated rows count one by one; a null id stays; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_a, n_b = len(_bytes_of_a(a_json)), len(Model(b_model).pieces)
    if max(n_a, n_b) > MAX_IDS:
        raise ValueError(f"vocabularies of {n_a} and {n_b} ids are too large for dense stripes")
    stripes = -(-n_a // STRIPE)
    made = checkpointed(_encoded(rows, a_json, b_model, stripes))
    pairs = made.where("kind = 0")
    counted = _returned(pairs, checkpointed(_stripes(pairs, n_b, stripes)))
    columns = made.columns

    @K.tidy
    def score(batches):
        """A batch's counts come first, then its links, then its documents."""
        now, parts, counts, sums = None, [], EMPTY, {}
        for batch in batches:
            of, kind, place = (batch.column(c).to_numpy() for c in ("batch", "kind", "place"))
            out = []
            for k in range(batch.num_rows):
                if of[k] != now:
                    now, parts, counts, sums = of[k], [], EMPTY, {}
                if kind[k] == 0:
                    parts.append(batch.column("counts")[k].values.to_numpy())
                    continue
                if parts:
                    counts, parts = np.concatenate(parts), []
                if kind[k] == 1:
                    n = batch.column("numbers")[k].values[0].as_py()
                    doc, number, times = _unpacked(batch.column("body")[k].as_py(), n)
                    count = counts[number]
                    width = int(doc[-1]) + 1 if n else 0
                    best, total = np.zeros(width, np.int64), np.zeros(width, np.int64)
                    np.add.at(best, doc, times * (count > 0))
                    np.add.at(total, doc, times * np.abs(count))
                    sums |= {int(place[k]) + d: (int(best[d]), int(total[d])) for d in np.flatnonzero(total).tolist()}
                else:
                    out.append((k, *sums.pop(int(place[k]), (0, 0))))
            if out:
                part = batch.take(pa.array([o[0] for o in out]))
                numbers = np.stack(part.column("numbers").to_numpy(zero_copy_only=False)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(numbers[:, c].copy()) for c in range(4)], pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), part.column("digest")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    null = lambda c: F.lit(None).cast(made.schema[c].dataType).alias(c)
    back = counted.select("batch", F.lit(0).alias("kind"), "place", null("doc_id"), null("numbers"), null("body"), null("digest"), "counts")
    both = back.union(made.where("kind > 0").select(columns))
    ordered = both.repartition("batch").sortWithinPartitions("batch", "kind", "place")
    kind = made.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(score, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def tokenizer_json(spark, path: str) -> str:
    """The text of a tokenizer's JSON file, of the driver or of a store that Spark reads."""
    return load(spark, path).decode("utf-8")
