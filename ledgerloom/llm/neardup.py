"""Near-duplicate documents by ProbMinHash.

A document is a set of five-word shingles, which all weigh the same however often they
repeat. Each shingle is a Poisson process whose rate is its weight: its arrivals fall on random
registers, a register keeps the earliest shingle, and a process stops once its next arrival is
later than all registers (early termination). Two documents agree in a register with the
probability of their probability Jaccard similarity, which with equal weights is the Jaccard
similarity of the shingle sets. Bands of registers give candidates; the shingle sets of those
are compared exactly.

Equal texts are one vertex. Within a band's bucket, the vertex with the most
bucket mates is the hub, and members are compared with the hub only, which joins nearly
all that belongs together; members of what is left in more than one component are
compared in blocks. Nothing emits all pairs of a group, and no bucket is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import checkpointed, components, release, spread

WIDTH = 5
THRESHOLD = 0.8
#: With 24 bands of 4 registers, a pair of similarity 0.8 shares no band with probability 3e-6, one of 0.6 with 0.04.
BANDS, ROWS = 24, 4
#: The registers beyond the bands only sharpen the estimate.
REGISTERS = 160
#: Least shares of equal registers with which a pair's texts are compared: 8 standard errors below the threshold for a
#: bucket's hub and its members; for pairs that would join what the hubs left apart, 104 of 160 registers, which a pair
#: of similarity 0.8 misses with probability 3e-6, as rarely as the bands.
ESTIMATE, LIKELY = 0.55, 0.65
#: Members of a bucket that one task compares.
BLOCK = 512


def once(docs, shingles):
    """Distinct (document, shingle)."""
    order = np.lexsort((shingles, docs))
    docs, shingles = docs[order], shingles[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (shingles[1:] != shingles[:-1])
    return docs[new], shingles[new]


def signatures(docs, shingles, weights, n, registers=REGISTERS):
    """The earliest shingle of each register of n documents; documents without a shingle have zeros."""
    earliest = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    active = np.arange(len(docs))
    clock = np.zeros(len(docs))
    step = 0
    while len(active):
        draw = K.mix(shingles[active] ^ K.mix(np.array([step + 1], np.uint64)))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights[active]
        at = docs[active] * registers + (K.mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, clock)
        won = earliest[at] == clock
        owner[at[won]] = shingles[active[won]]
        latest = earliest.reshape(n, registers).max(axis=1)
        going = clock < latest[docs[active]]
        active, clock = active[going], clock[going]
        step += 1
    return owner.reshape(n, registers)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest, bands and marks (16 bits of each register) of every row with a text.

    digest is of the whole text. Texts without a word have no bands.
    """

    @K.tidy
    def run(batches):
        weights = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
        for part, data, offsets in K.chunks(batches, "text", 1 << 20):
            n = len(offsets) - 1
            of, starts, ends = K.spans(~K.space(data), offsets)
            of, sh = K.shingles(of, K.span_hashes(data, starts, ends), WIDTH)
            of, sh = once(of, sh)
            sig = signatures(of, sh, np.ones(len(of)), n)
            filled = np.bincount(of, minlength=n) > 0
            keys = K.mix((sig[:, : BANDS * ROWS].reshape(n, BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            at = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
            marks = K.mix(sig).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[filled].reshape(-1).view(np.int64))), pa.array([m.tobytes() for m in marks], pa.binary())], ["doc_id", "digest", "bands", "marks"])

    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text").where("text is not null and doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, digest binary, bands array<long>, marks binary")


def distinct(text: bytes):
    """A text's distinct shingles, in order."""
    data = np.frombuffer(text, np.uint8)
    of, starts, ends = K.spans(~K.space(data), np.array([0, len(data)]))
    return np.unique(K.shingles(of, K.span_hashes(data, starts, ends), WIDTH)[1])


def _agreeing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough equal registers."""

    @K.tidy
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= ESTIMATE))

    side = lambda c, m: marks.select(F.col("doc").alias(c), F.col("marks").alias(m))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the compressed text of every row that has both: half as many bytes to shuffle."""

    @K.tidy
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for part, data, offsets in K.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["doc_id", "packed"])

    return docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInArrow(run, "doc_id long, packed binary")


def _measured(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs with the exact similarity of their texts; both joins read one exchange of the texts.

    With a's number of shingles, and the hashes of those that b lacks and of those that b has beyond them.
    """

    @K.tidy
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            found, size, lacks, adds = [], [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = distinct(unpack(x.as_py())), distinct(unpack(y.as_py()))
                less, more = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                found.append((len(a) - len(less)) / max(1, len(a) + len(more)))
                size.append(len(a))
                lacks.append(less.view(np.int64))
                adds.append(more.view(np.int64))
            sets = [pa.array(v, pa.list_(pa.int64())) for v in (lacks, adds)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64()), pa.array(size, pa.int64()), *sets], ["a", "b", "similarity", "size", "lacks", "adds"])

    texts = _packed(docs)
    first = pairs.join(texts.withColumnRenamed("packed", "y"), F.col("b") == F.col("doc_id")).select("a", "b", "y")
    joined = first.join(texts.withColumnRenamed("packed", "x"), F.col("a") == F.col("doc_id")).select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, similarity double, size long, lacks array<long>, adds array<long>")


def _linked(measured: DataFrame, threshold: float) -> DataFrame:
    return measured.where(F.col("similarity") >= threshold).select("a", "b").distinct()


def _shared(lists: pa.Array, left, right):
    """Numbers of common elements of the sets at ``left`` and those at ``right``."""
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(starts)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    _, column, count = np.unique(flat[starts[0] : starts[-1]], return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    rows, column = rows[often[column]], place[column[often[column]]]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(often.sum()), 4096):
        here = (column >= lo) & (column < lo + 4096)
        block = np.zeros((len(sizes), 4096), np.float32)
        block[rows[here], column[here] - lo] = 1
        out += block[left] @ block[right].T
    return out


def _rest(members: DataFrame, measured: DataFrame, found: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that share a bucket and have to be measured.

    In a bucket the largest component's members need no comparison with each other: the rest
    is compared with them and with itself, in blocks of BLOCK members, and each pair in the
    first bucket it shares. Hubs have been compared already. Where two members' differences
    from the hub are known, these give their similarity, and a block returns a
    spanning forest of its links. Other pairs, of members too far from the hub to have been
    compared with it, are candidates if enough registers are equal.
    """
    placed = members.join(found.select(F.col("id").alias("doc"), "component"), "doc", "left").select("key", "band", "hub", "doc", F.coalesce("component", "doc").alias("component"))
    placed = checkpointed(placed)
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all")).where("n_all > n_main")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    top = top.select((F.col("key") + F.lit(0)).alias("key"), "main", blocks(F.col("n_main")).alias("main_blocks"), blocks(F.col("n_all") - F.col("n_main")).alias("rest_blocks"))
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    rows = placed.where("doc != hub").join(top, "key").withColumn("in_main", F.col("component") == F.col("main")).withColumn("own", own)
    facts = ["size", "lacks", "adds"]
    known = measured.select(F.col("a").alias("hub"), F.col("b").alias("doc"), *facts)
    rows = rows.join(known, ["hub", "doc"], "left").join(marks.select("doc", "marks"), "doc")
    others = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spot = lambda across, i, j: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    mine = F.col("own")
    spots = F.when(F.col("in_main"), F.transform(others("rest_blocks"), lambda r: spot(True, r, mine))).otherwise(F.concat(F.transform(others("main_blocks"), lambda m: spot(True, mine, m)), F.transform(others("rest_blocks"), lambda r: spot(False, F.least(r, mine), F.greatest(r, mine)))))
    dealt = rows.select("key", "band", "doc", "component", "in_main", "own", *facts, "marks", F.inline(spots))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, comp, own_block = (table.column(c).to_numpy() for c in ("doc", "component", "own"))
        in_main = np.asarray(table.column("in_main").to_pylist(), bool)
        marks_of = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        across, i, j, band = (table.column(c)[0].as_py() for c in ("across", "i", "j", "band"))
        left = np.flatnonzero(~in_main if across else own_block == i)
        right = np.flatnonzero(in_main if across else own_block == j)
        hub_size = table.column("size").to_numpy().astype(float)
        exact = ~np.isnan(hub_size)
        sets = [table.column(c).combine_chunks().fill_null([]) for c in ("lacks", "adds")]
        lacking, adding = (np.diff(x.offsets.to_numpy()).astype(float) for x in sets)
        both_lack, both_add = (_shared(x, left, right) for x in sets)
        sizes = hub_size - lacking + adding
        parent = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        out = []
        for at, k in enumerate(left):
            wanted = comp[right] != comp[k]
            if not across and i == j:
                wanted &= doc[right] > doc[k]
            sure = wanted & exact[right] & exact[k]
            inter = hub_size[k] - (lacking[k] + lacking[right] - both_lack[at]) + both_add[at]
            # whole hashes on both sides: what is near here is a link when it is measured, so it may join components
            near = sure & (inter >= threshold * (sizes[k] + sizes[right] - inter) - 1e-9)
            for m in right[near]:
                x, y = root(comp[k]), root(comp[m])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((doc[k], doc[m]))
            maybe = right[wanted & ~sure]
            equal = marks_of[maybe] == marks_of[k]
            likely = equal.mean(axis=1) >= LIKELY
            maybe, equal = maybe[likely], equal[likely]
            first = equal[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            out += [(doc[k], doc[m]) for m in maybe[first]]
        a, b = (np.array([f(o[0], o[1]) for o in out], np.int64) for f in (min, max))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("key", "across", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (smallest id of its group) of every distinct non-null document id.

    Two documents are linked if their texts are equal or the Jaccard similarity of their
    shingle sets is at least ``threshold``; groups are the links' components. A text of under five words is one
    shingle. Null texts link with nothing; texts without a word only with equal ones.
    Rows with one id are one document, in the smaller class if their texts differ. Null ids are left out. Ids are longs.
    Ties go to the smallest id, and columns other than the two named don't matter, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    every = checkpointed(sketch(docs))
    # equal texts: one vertex, the smallest id; partial aggregation merges copies before the shuffle
    unique = checkpointed(every.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("marks").alias("marks")))
    keyed = unique.select("doc", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select((F.col("key") + F.lit(0)).alias("key"), "n")
    members = checkpointed(keyed.join(shared, "key").select("key", "band", "doc", "n"))
    degree = spread(members.groupBy("doc").agg(F.sum("n").alias("degree")), "doc")
    hubs = members.join(degree, "doc").groupBy("key").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("hub"))
    members = checkpointed(members.join(spread(hubs, "key"), "key").select("key", "band", "hub", "doc"))
    spokes = members.where("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    measured = checkpointed(_measured(checkpointed(_agreeing(spokes, unique)), docs))
    links = _linked(measured, threshold)
    release(docs.sparkSession)
    found = components(links)
    rest = checkpointed(_rest(members, measured, found, unique, threshold))
    if rest.agg(F.count("*")).head()[0]:
        links = links.union(checkpointed(_linked(_measured(rest, docs), threshold)))
        found = components(links)
    named = unique.select("digest", "doc").join(found.withColumnRenamed("id", "doc"), "doc", "left").select(F.concat("digest", F.lit(b"")).alias("digest"), F.coalesce("component", "doc").alias("class_id"))
    linked = every.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id")
    alone = docs.where("text is null and doc_id is not null").select("doc_id", F.col("doc_id").alias("class_id"))
    both = linked.union(alone)
    return both.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names its group.

    Rows with a null id stay; of rows with one id any one stays; a null text is a group of its own; equal texts, empty
    ones too, are one group.
    """
    first = classes(docs, threshold).where("doc_id = class_id").select(F.col("doc_id").alias("__near_kept"))
    kept = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col("__near_kept"), "left_semi")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    if ids is not None and ids > 1:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
