"""Embedding near-dedup on an inverted multi-index.

The halves of unit vectors have codebooks of their own, whose product is a grid of cells. Every
vector is stored in one cell and visits the cells nearest to it in order of the sum of its
halves' distances (multi-sequence traversal). The number of visits is the least with which
pairs at the threshold, drawn at random around sampled vectors, are met from either
side with the target recall. Stored and visiting vectors of a cell are verified by
cosine in double precision, block by block; a block returns counts and a spanning
forest of its links, never its pairs. Equal vectors are stored once with their number.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, components, spread

THRESHOLD = 0.9
RECALL = 0.98
#: Codebooks are fitted on at most about this many vectors; every vector is indexed.
SAMPLE = 8192
STORED, VISITING = 1024, 4096
#: Vectors that a cell is to hold, on which the size of the codebooks depends up to MAX_WORDS: a vector travels once for every
#: cell that it visits, and larger cells need fewer visits, while comparing a block of them is one product of matrices.
IN_CELL = 512
MAX_WORDS = 512


def unit(v):
    """Rows at length 1, in double precision."""
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codebook(points, k, rounds=12, seed=3):
    """k-means centres of the points."""
    order = np.random.default_rng(seed)
    centres = points[order.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        count = np.bincount(near, minlength=k)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def distances(points, centres):
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def traverse(first, second, visits):
    """The ``visits`` cells with the least first[i] + second[j], by multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    fa, fb = first[a], second[b]
    k, out, heap, seen = len(fb), [], [(fa[0] + fb[0], 0, 0)], {(0, 0)}
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * k + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(fa) and y < k and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (fa[x] + fb[y], x, y))
    return out


class Index:
    """Two codebooks and the number of visits that reaches the recall."""

    def __init__(self, sample, rows, threshold=THRESHOLD, recall=RECALL, seed=5):
        self.half = sample.shape[1] // 2 or 1
        k = int(min(MAX_WORDS, max(1, 2 ** round(np.log2(max(rows / IN_CELL, 1)) / 2)), max(1, len(sample))))
        self.books = codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k) if sample.shape[1] > self.half else np.zeros((1, 0))
        order = np.random.default_rng(seed)
        x = sample[order.choice(len(sample), 1000)]
        noise = order.normal(size=x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = threshold * x + np.sqrt(1 - threshold**2) * noise
        self.visits = int(np.quantile(np.minimum(self._rank(x, y), self._rank(y, x)), recall)) + 1

    def halves(self, v):
        return distances(v[:, : self.half], self.books[0]), distances(v[:, self.half :], self.books[1])

    def cells(self, v):
        a, b = self.halves(v)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _rank(self, x, y):
        """How many cells are nearer to x than y's own."""
        (a, b), (ya, yb) = self.halves(x), self.halves(y)
        i, j = ya.argmin(1), yb.argmin(1)
        out = np.zeros(len(x), np.int64)
        for r in range(len(x)):
            out[r] = (a[r][:, None] + b[r][None] < a[r, i[r]] + b[r, j[r]]).sum()
        return out


def _matrix(column):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _forest(links, left, right):
    """For the ids with a link: the id and its component's smallest id."""
    i, j = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    sub = links[np.ix_(i, j)]
    top = np.iinfo(np.int64).max
    a, b = left[i].copy(), right[j].copy()
    while True:
        low_a = np.minimum(a, np.where(sub, b[None, :], top).min(1))
        low_b = np.minimum(b, np.where(sub, low_a[:, None], top).min(0))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    return np.concatenate([left[i], right[j]]), np.concatenate([a, b])


def _compare(threshold):
    def run(table: pa.Table) -> pa.Table:
        visiting = table.column("visiting").to_numpy(zero_copy_only=False).astype(bool)
        ids, times, own = (table.column(c).to_numpy() for c in ("vec", "times", "own"))
        v = unit(_matrix(table.column("embedding")))
        m, x = np.flatnonzero(~visiting), np.flatnonzero(visiting)
        cell = table.column("cell")[0].as_py()
        links = (v[x] @ v[m].T >= threshold) & (ids[x][:, None] != ids[m][None])
        if not links.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        lists = table.column("visits").combine_chunks()
        goes = _matrix(lists.take(pa.array(m)))
        # the stored vector meets the visitor again, the other way, if it visits the visitor's cell
        met = np.zeros(links.shape, bool)
        for c in np.unique(own[x]):
            met[own[x] == c] = True if c == cell else (goes == c).any(1)[None]
        to_x = (links * times[m][None]).sum(1)
        to_m = ((links & ~met) * times[x][:, None]).sum(0)
        node, root = _forest(links, ids[x], ids[m])
        far = node != root
        a = np.concatenate([ids[x][to_x > 0], ids[m][to_m > 0], node[far]])
        b = np.concatenate([ids[x][to_x > 0], ids[m][to_m > 0], root[far]])
        n = np.concatenate([to_x[to_x > 0], to_m[to_m > 0], np.zeros(int(far.sum()), np.int64)])
        return pa.table({"a": pa.array(a), "b": pa.array(b), "n": pa.array(n.astype(np.int64))})

    return run


def _key():
    """128 bits of a vector, by which its copies find it again."""
    return F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("second"), "embedding").alias("h2")


def link(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors of one length are linked if their cosine is at least ``threshold``: no link is below it, and
    of the others at least ``recall`` is expected. n_links counts other rows, equal
    vectors included; component_id is the smallest vec_id reachable. Vectors that are null,
    empty, zero, or hold null or non-finite components, and rows with a null id, link with nothing, nor do vectors of
    different lengths. Rows with one id are vectors of their own. Each length has an index of its own; tables
    are expected to have one length or few. Other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = ~F.exists("embedding", odd) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    fit = F.coalesce(sound, F.lit(False))
    out = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = rows.where(fit).groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length")
    for length, _ in lengths.collect():
        out = out.unionByName(_linked(rows.where(fit & (F.size("embedding") == length)), threshold, recall))
    return out


def _linked(good: DataFrame, threshold: float, recall: float) -> DataFrame:
    """vec_id, n_links, component_id and kept of sound vectors of one length, of which there is one at least."""
    unique = checkpointed(good.groupBy("embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("times")))
    total = unique.count()
    share = int(min(1.0, SAMPLE / total) * (1 << 31))
    sample = unique.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 31)) <= share).select("embedding").toArrow()
    if not sample.num_rows:
        sample = unique.limit(1).select("embedding").toArrow()
    index = Index(unit(_matrix(sample.column("embedding"))), total, threshold, recall)
    shared = good.sparkSession.sparkContext.broadcast(index)  # two codebooks of at most MAX_WORDS half vectors

    def place(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                v = unit(_matrix(part.column("embedding")))
                a, b = shared.value.halves(v)
                visits = [traverse(p, q, shared.value.visits) for p, q in zip(a, b, strict=True)]
                cells = pa.array(shared.value.cells(v).astype(np.int32))
                made = [*[part.column(c) for c in ("vec", "times", "embedding")], cells, pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(made, ["vec", "times", "embedding", "own", "visits"])

    kind = good.schema["embedding"].dataType.simpleString()
    schema = f"vec long, times long, embedding {kind}, own int, visits array<int>"
    placed = checkpointed(unique.select("vec", "times", "embedding").mapInArrow(place, schema))
    stored = placed.groupBy(F.col("own").alias("cell")).agg(F.count("*").alias("n_stored"))
    coming = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("n_coming"))
    # one small row a cell, of which there are at most MAX_WORDS squared
    blocks = [F.ceil(F.col(n) / most).cast("int").alias(c) for n, most, c in (("n_stored", STORED, "ms"), ("n_coming", VISITING, "vs"))]
    cells = F.broadcast(checkpointed(stored.join(coming, "cell").select("cell", *blocks)))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    block = lambda c: F.pmod(F.xxhash64("vec"), F.col(c)).cast("int")
    columns = ["cell", "visiting", "vec", "times", "own", "embedding", "visits"]
    at_home = placed.withColumn("cell", F.col("own")).withColumn("visiting", F.lit(False)).join(cells, "cell")
    at_home = at_home.select(*columns, block("ms").alias("i"), F.explode(upto("vs")).alias("j"))
    away = placed.withColumn("cell", F.explode("visits")).withColumn("visiting", F.lit(True)).withColumn("visits", F.array().cast("array<int>"))
    away = away.join(cells, "cell").select(*columns, F.explode(upto("ms")).alias("i"), block("vs").alias("j"))
    met = at_home.union(away).groupBy("cell", "i", "j").applyInArrow(_compare(threshold), "a long, b long, n long")
    found = checkpointed(met)
    counts = spread(found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")), "a")
    comps = components(found.where("n = 0")).withColumnRenamed("id", "vec")
    about = unique.select("vec", "times", *_key()).join(counts, F.col("vec") == F.col("a"), "left").join(comps, "vec", "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long")
    about = about.select("h1", "h2", links.alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    named = good.select("vec_id", *_key()).join(about, ["h1", "h2"])
    return named.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
