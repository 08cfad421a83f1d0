"""Prefix trie of conversations, encoded by preorder intervals.

Conversations are rebuilt (heads of a base conversation, then their own turns) and ranked in lexicographic order
of their turns: blocks of ``FAN`` turns get the rank of their content, blocks of ``FAN`` ranks the rank
of theirs, and so on, so the rounds follow the logarithm of the longest conversation. In that order a node's
members are neighbours, and every distinct conversation brings in the nodes below its common prefix with the one
before it. This numbers the nodes in preorder; a node's subtree ends where its last member's nodes end, and
leaves and savings are differences of running sums over the preorder.

Running sums are made in sorted partitions, with one offset a partition. No conversation, node or group of copies
is ever held by one task: rows of one conversation are split by turn, copies by their ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import checkpointed, release, spread

#: Turns, or ranks, that make one block of the next level.
FAN = 16
#: Bytes of joined ids that one row carries to the digest of a node's ends.
PIECE = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
GROUP, HEADS = 5, 9


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with a running sum of the column ``source`` before each row, for each ``name: source`` in ``sums``.

    Rows follow ``order``, which must be unique; sources are longs of zero or more. Each sorted partition adds up its own
    rows as a stream, and gets the sum of the partitions before it from a table of one row a partition.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    kinds += "".join(f", `{name}` long" for name in sums) + ", _part int"
    names = [*df.columns, *sums, "_part"]

    @K.tidy
    def run(batches):
        part, so_far = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = list(batch.columns)
            for name, source in sums.items():
                value = batch.column(batch.schema.get_field_index(source)).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(value) + so_far[name]
                columns.append(pa.array(upto - value))
                so_far[name] = int(upto[-1]) if len(upto) else so_far[name]
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = checkpointed(sorted_rows.mapInArrow(run, kinds))
    totals = local.groupBy("_part").agg(*[F.max(F.col(name) + F.col(source)).alias(name) for name, source in sums.items()])
    # as many rows as partitions
    rows = [tuple(r) for r in totals.orderBy("_part").collect()]
    before, offsets = [0] * len(sums), []
    for part, *found in rows:
        offsets.append((part, *before))
        before = [x + y for x, y in zip(before, found, strict=True)]
    shift = df.sparkSession.createDataFrame(offsets, "_part int" + "".join(f", `{name}_0` long" for name in sums))
    joined = local.join(F.broadcast(shift), "_part")
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"{name}_0")).alias(name) for name in sums])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (the turn's number over all conversations, in order), digest and bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("turn").isNotNull().cast("int").alias("known"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"))
    placed = running(rows, ["conv_id", "known", "turn", "role", "text"], {"at": "one"})
    # the length keeps a role's end apart from a text's start
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")))
    return placed.select("conv_id", "at", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, d, digest and bytes of every rebuilt turn (d from 1), and a row of d = 0 for every conversation."""
    own = checkpointed(turns(conversations))
    known = own.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    convs = known.select("conv_id", "first", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), heads(F.col("conv_id")).alias("h"))
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left")
    itself = F.col("base") == F.col("conv_id")
    taken = F.when(itself, 0).otherwise(F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = checkpointed(convs.select("conv_id", "first", "base", F.when(itself, 0).otherwise(F.col("h")).alias("h"), taken.alias("taken")))
    rows = own.join(spread(convs, "conv_id"), "conv_id").withColumn("i", F.col("at") - F.col("first"))
    tail = rows.where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken") + 1).alias("d"), "digest", "bytes")
    # at most HEADS - 1 turns of a base, and GROUP - 1 conversations on either side of it
    lent = rows.where(F.col("i") < HEADS - 1).select(F.col("conv_id").alias("base"), "i", "digest", "bytes")
    takers = convs.where("h > 0").select("conv_id", "base", "h")
    head = lent.join(takers, "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("d"), "digest", "bytes")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return checkpointed(tail.union(head).union(root))


def ranked(rows: DataFrame, longest: int) -> DataFrame:
    """conv_id, n (turns) and name of every conversation; names follow the lexicographic order of the digests."""
    level = rows.select("conv_id", F.col("d").alias("j"), F.col("digest").alias("name"), F.col("d").alias("n"))
    while True:
        block = F.sort_array(F.collect_list(F.struct((F.col("j") % FAN).alias("k"), "name")))["name"]
        whole = F.floor(F.col("j") / FAN)
        blocks = level.groupBy("conv_id", whole.alias("j")).agg(block.alias("key"), F.max("n").alias("n"))
        distinct = blocks.select("key").distinct().orderBy("key")
        names = checkpointed(distinct.withColumn("name", F.monotonically_increasing_id()))
        # without its order's partitioning, so that the join may split a key that many conversations share
        names = names.withColumn("key", F.slice("key", 1, FAN))
        level = checkpointed(blocks.join(names, "key").select("conv_id", "j", "name", "n"))
        release(rows.sparkSession)
        longest //= FAN
        if longest == 0:
            return level.select("conv_id", "n", "name")


def ends(members: DataFrame) -> DataFrame:
    """r and the SHA-256 of its members' decimal conv_ids, ascending and joined by commas.

    Sorted partitions join their ids into pieces of ``PIECE`` bytes; one task reads a node's pieces as a stream, for the digest
    has an order.
    """

    @K.tidy
    def join(batches):
        part, at, now, kept, size = TaskContext.get().partitionId(), 0, None, [], 0

        def piece():
            return pa.RecordBatch.from_pydict({"r": pa.array([now], pa.int64()), "part": pa.array([part], pa.int32()), "at": pa.array([at], pa.int64()), "ids": [",".join(kept)]})

        for batch in batches:
            for r, conv in zip(batch.column("r").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if kept and (r != now or size > PIECE):
                    yield piece()
                    at, kept, size = at + 1, [], 0
                now = r
                kept.append(str(conv))
                size += len(kept[-1]) + 1
        if kept:
            yield piece()

    @K.tidy
    def digest(batches):
        now, state, found = None, None, []
        for batch in batches:
            for r, ids in zip(batch.column("r").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if r != now:
                    if state is not None:
                        found.append((now, state.hexdigest()))
                    now, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if len(found) > 10_000:
                yield pa.RecordBatch.from_pydict({"r": [x for x, _ in found], "ends_sha256": [x for _, x in found]})
                found = []
        if state is not None:
            found.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_pydict({"r": [x for x, _ in found], "ends_sha256": [x for _, x in found]})

    pieces = members.repartitionByRange("r", "conv_id").sortWithinPartitions("r", "conv_id").select("r", "conv_id").mapInArrow(join, "r long, part int, at long, ids string")
    return pieces.repartition("r").sortWithinPartitions("r", "part", "at").mapInArrow(digest, "r long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node of the rebuilt conversations' prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Also first and last, the node's preorder number (the root's is 0) and the number after its subtree's.

    Turns with the same number follow role, then text; repeated rows are turns of their own. A null turn comes first, null
    roles and texts are empty, other columns are ignored. Rows without a conv_id belong to no
    conversation and are left out; without any conversation there is no node, not even the root.
    """
    rows = rebuilt(conversations)
    longest = rows.agg(F.max("d")).head()[0] or 0
    named = ranked(rows, longest)
    one = F.lit(1).cast("long")
    groups = named.groupBy("name").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.max("n").alias("n"))
    seqs = checkpointed(running(groups.withColumn("one", one), ["name"], {"r": "one"}).drop("one"))
    # one copy of each distinct conversation
    texts = checkpointed(rows.join(spread(seqs.select("conv_id", "r"), "conv_id"), "conv_id").select("r", "d", "digest", "bytes"))
    before = texts.select((F.col("r") + 1).alias("r"), "d", F.col("digest").alias("other"))
    differs = texts.join(before, ["r", "d"], "left").where("other is null or other != digest")
    common = checkpointed(differs.groupBy("r").agg((F.min("d") - 1).alias("lcp")))
    after = common.select((F.col("r") - 1).alias("r"), F.col("lcp").alias("next_lcp"))
    counts = seqs.join(common, "r").join(after, "r", "left").select("r", "conv_id", "copies", "n", "lcp", (F.col("n") - F.col("lcp")).alias("brings"), (F.coalesce("next_lcp", F.lit(-1)) < F.col("n")).alias("leaf"))
    counts = running(counts, ["r"], {"start": "brings"})
    new = F.col("d") > F.col("lcp")
    passing = texts.select("r", "d", "bytes").join(spread(counts, "r"), "r").withColumn("new", new.cast("long"))
    # level by level, in the order of the conversations: every new node starts a run of those that pass through it
    levels = running(passing, ["d", "r"], {"upto": "new"}).withColumn("node", F.col("upto") + F.col("new"))
    levels = checkpointed(levels.drop("upto"))
    here = lambda c: F.max(F.when(F.col("new") == 1, c))
    nodes = levels.groupBy("node").agg(
        F.min("d").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("copies").alias("n_convs"),
        here(F.col("r")).alias("r"),
        here(F.col("start") + F.col("d") - F.col("lcp") - 1).alias("first"),
        F.max(F.col("start") + F.col("brings")).alias("last"),
        here(F.col("bytes")).alias("bytes"),
        here((F.col("d") == F.col("n")).cast("long")).alias("top"),
        here(((F.col("d") == F.col("n")) & F.col("leaf")).cast("long")).alias("leaf"),
    )
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    placed = checkpointed(running(nodes, ["first"], {"leaves_before": "leaf", "saved_before": "saved"}))
    release(placed.sparkSession)
    sums = placed.agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).head()
    stop = placed.select(F.col("first").alias("last"), F.col("leaves_before").alias("leaves_upto"), F.col("saved_before").alias("saved_upto"))
    closed = placed.join(spread(stop, "last"), "last", "left")
    n_leaves = F.coalesce("leaves_upto", F.lit(sums[0] or 0)) - F.col("leaves_before")
    saved = F.coalesce("saved_upto", F.lit(sums[1] or 0)) - F.col("saved_before")
    closed = closed.select("node", "depth", "conv_id", "n_convs", "r", "top", "first", "last", n_leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"))
    above = levels.select("r", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    edges = checkpointed(levels.where("new = 1").select("r", "d", "node").join(above, ["r", "d"]).select("node", "parent"))
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    owner = placed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = edges.join(spread(owner, "parent"), "parent").select("node", "parent_conv_id")
    whole = closed.join(parents, "node", "left").join(children, "node", "left")
    members = named.join(spread(seqs.select("name", "r"), "name"), "name").select("r", "conv_id")
    ended = whole.where("top = 1").join(ends(members), "r")
    passed = whole.where("top = 0").withColumn("ends_sha256", F.lit(NOTHING))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256", "first", "last"]
    return ended.select(*columns).union(passed.select(*columns))
