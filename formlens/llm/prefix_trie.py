"""The trie of conversation prefixes, with subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formlens.llm.common import bounded_batches, stored

HEAD_TURNS = 9
FAMILY = 5
CHUNK_IDS = 8_192
DEPTH_BITS = 20
NOTHING = hashlib.sha256(b"").hexdigest()
OWN = ["leaves", "saved"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n, c1, c2, n_bytes)``: turns from 1 in the order of ``turn`` (null first), texts as two hashes.

    Null roles and texts are empty. Rows of one turn number follow each other in the order of their
    hashes. Rows without a ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(F.lit("first"), role, text).alias("c1"),
        F.xxhash64(F.lit("second"), role, text).alias("c2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "c1", "c2")
    return turns.withColumn("n", F.row_number().over(order)).drop("turn")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family of five: ``(turns, conversations)``.

    Conversation c takes the first h turns of conversation ``c - c % 5`` and goes on with its own
    turns after its first h, where h is the CRC-32 of the digits of c modulo 9. The first result has
    ``(conv_id, depth, c1, c2, n_bytes, total)``, the second ``(conv_id, total)``, also for
    conversations that are left without a turn.
    """
    own = F.col("conv_id")
    sizes = stored(turns.groupBy("conv_id").agg(F.count("*").alias("size")), "conversations")
    heads = sizes.select(
        "conv_id", "size", (own - own % FAMILY).alias("head"), (F.crc32(own.cast("string")) % HEAD_TURNS).alias("h")
    )
    heads = heads.join(sizes.select(F.col("conv_id").alias("head"), F.col("size").alias("head_size")), "head", "left")
    taken = F.least("h", F.coalesce("head_size", F.lit(0)))
    heads = heads.withColumn("taken", taken).withColumn("total", taken + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    heads = stored(heads.select("conv_id", "head", "h", "taken", "total"), "heads")

    later = turns.join(heads, "conv_id").filter("n > h").withColumn("depth", F.expr("taken + n - h"))
    first = turns.filter(F.col("n") < HEAD_TURNS).withColumnRenamed("conv_id", "head")
    first = heads.filter("taken > 0").join(first, "head").filter("n <= taken").withColumn("depth", F.col("n"))
    columns = [own, F.col("depth").cast("long").alias("depth"), "c1", "c2", "n_bytes", "total"]
    return later.select(*columns).unionByName(first.select(*columns)), heads.select("conv_id", "total")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the identity ``(i, j)`` of its prefix and ``(pi, pj)`` of the one before.

    An identity is the exclusive or of two hashes of each turn with its place, 128 bits in all, so
    that a running aggregate makes it and the turns before never meet in one row.
    """
    lanes = turns.withColumns({
        "x": F.xxhash64(F.lit(1), "depth", "c1", "c2"),
        "y": F.xxhash64(F.lit(2), "depth", "c1", "c2"),
    })
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lanes = lanes.withColumn("i", F.bit_xor("x").over(upto)).withColumn("j", F.bit_xor("y").over(upto))
    return lanes.withColumns({"pi": F.col("i").bitwiseXOR(F.col("x")), "pj": F.col("j").bitwiseXOR(F.col("y"))})


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(i, j, ends_sha256)``: the SHA-256 of the ids ``conv_id`` of each node, ascending, with commas between.

    A range partitioning over node *and* id cuts the ids of a common node into tasks, which join
    them to chunks; only the chunks of a node come together, in order, and are hashed one by one.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            node, ids = None, []
            for i, j, conv_id in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if node != (i, j) or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (i, j), []
                ids.append(conv_id)
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else []
            yield pa.RecordBatch.from_arrays(arrays or [pa.array([], kind) for kind in kinds], ["i", "j", "least", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for i, j, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if node == (i, j):
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (i, j), hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, digest.hexdigest()), strict=True))], schema)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["i", "j", "ends_sha256"]
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("ends_sha256", pa.string())])
    keys = ["i", "j", "conv_id"]
    cut = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = cut.mapInArrow(chunks, "i long, j long, least long, ids string")
    whole = cut.repartition("i", "j").sortWithinPartitions("i", "j", "least")
    return whole.mapInArrow(digests, "i long, j long, ends_sha256 string")


def _plus(name: str, *others: str) -> Column:
    return reduce(lambda a, b: a + F.coalesce(F.col(b), F.lit(0)), others, F.col(name)).alias(name)


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """``(i, j, leaves, saved)`` summed over every node's subtree, itself included.

    ``nodes`` has ``(i, j, pi, pj, depth, k, leaves, saved)``: identity, parent's identity, number of
    children, own amounts; the root is ``(0, 0)``. A round rakes all leaves (their totals are known and
    go to their parents) and compresses chains: of nodes with one child left, those are taken out whose
    depth has the round's bit set, never two that are adjacent, and the child carries the sum of what was
    taken out up to its new parent. Depths within a chain differ, so about half of each chain goes per
    round. When no node is left the rounds are undone, last first, and every node taken out gets its
    total from the child it had. Joins are between tables of unique keys, whatever a node's degree.
    """
    keys, parent = ["i", "j"], ["pi", "pj"]
    tree = stored(nodes.select(*keys, *parent, "depth", "k", *OWN, *(F.lit(0).cast("long").alias(f"up_{name}") for name in OWN)), "tree")
    known, taken_out = [], []
    for turn in range(1 << 30):
        leaves = tree.filter("k = 0")
        known.append(leaves.select(*keys, *OWN))
        given = leaves.groupBy(*parent).agg(
            F.count("*").alias("n_raked"), *(F.sum(F.col(name) + F.col(f"up_{name}")).alias(f"got_{name}") for name in OWN)
        )
        given = given.select(F.col("pi").alias("i"), F.col("pj").alias("j"), "n_raked", *(f"got_{name}" for name in OWN))
        trunk = tree.filter("k > 0").join(given, keys, "left").select(
            *keys, *parent, "depth", (F.col("k") - F.coalesce("n_raked", F.lit(0))).alias("k"),
            *(_plus(name, f"got_{name}") for name in OWN), *(f"up_{name}" for name in OWN),
        )
        trunk = stored(trunk, "trunk")
        if trunk.isEmpty():
            break
        bit = F.shiftright("depth", turn % DEPTH_BITS).bitwiseAND(F.lit(1)) == 1
        # Of a node with one child this is the child; other groups are not looked at.
        child = trunk.groupBy(*parent).agg(
            F.max("i").alias("ci"), F.max("j").alias("cj"), F.max((F.col("k") == 1) & bit).alias("child_goes"),
            *(F.max(f"up_{name}").alias(f"child_up_{name}") for name in OWN),
        )
        child = child.withColumnsRenamed({"pi": "i", "pj": "j"})
        chosen = trunk.filter((F.col("k") == 1) & bit & (F.col("depth") > 0)).join(child, keys).filter(~F.col("child_goes"))
        chosen = stored(chosen, "taken-out")
        taken_out.append(chosen)
        above = chosen.select(
            F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("pi").alias("qi"), F.col("pj").alias("qj"),
            *((F.col(name) + F.col(f"up_{name}")).alias(f"by_{name}") for name in OWN),
        )
        left = trunk.join(chosen.select(*keys), keys, "left_anti").join(above, keys, "left")
        tree = stored(left.select(
            *keys, F.coalesce("qi", "pi").alias("pi"), F.coalesce("qj", "pj").alias("pj"), "depth", "k", *OWN,
            *(_plus(f"up_{name}", f"by_{name}") for name in OWN),
        ), "tree")
    later = known[len(taken_out):]
    for turn in reversed(range(len(taken_out))):
        below = reduce(DataFrame.union, later).select(
            F.col("i").alias("ci"), F.col("j").alias("cj"), *(F.col(name).alias(f"of_{name}") for name in OWN)
        )
        back = taken_out[turn].join(below, ["ci", "cj"])
        back = back.select(*keys, *(_plus(name, f"child_up_{name}", f"of_{name}") for name in OWN))
        later = [known[turn], stored(back, "expanded"), *later]
    return reduce(DataFrame.union, later)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of ``conversations``, from the root without a turn.

    ``turns`` has ``(conv_id, depth, c1, c2, n_bytes, total)``, a row per turn with its place from 1, two
    hashes of what it says, its bytes and the conversation's number of turns; ``conversations`` has
    ``(conv_id, total)``. The result has ``conv_id`` (smallest of those that begin so), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (of the subtree),
    ``saved_tokens`` (bytes of the last turns of the subtree's nodes times their conversations but one) and
    ``ends_sha256`` of the ids that end there. No conversation, no node. A conversation's turns pass
    one task, in order, as sums; nothing else is gathered by conversation or node.
    """
    bounded_batches(turns.sparkSession)
    everyone = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    prefixes = stored(_prefixes(turns), "prefixes")
    nodes = prefixes.groupBy("i", "j", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
        F.max("pi").alias("pi"), F.max("pj").alias("pj"),
    )
    columns = ["i", "j", "pi", "pj", "depth", "conv_id", "n_convs", "n_bytes"]
    no_root = [] if everyone["conv_id"] is None else [(0, 0, None, None, 0, everyone["conv_id"], everyone["n_convs"], 0)]
    root = turns.sparkSession.createDataFrame(no_root, ", ".join(f"{name} long" for name in columns))
    nodes = stored(nodes.select(*columns).union(root), "nodes")
    if nodes.isEmpty():
        degrees = nodes.select("i", "j", F.lit(0).cast("long").alias("n_children"))
        totals = nodes.select("i", "j", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    else:
        degrees = nodes.filter("depth > 0").groupBy("pi", "pj").agg(F.count("*").alias("n_children"))
        degrees = stored(degrees.withColumnsRenamed({"pi": "i", "pj": "j"}), "degrees")
        tree = nodes.join(degrees, ["i", "j"], "left").withColumn("k", F.coalesce("n_children", F.lit(0)))
        totals = subtree_totals(tree.withColumns({
            "leaves": (F.col("k") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes"),
        }))
    ends = prefixes.filter("depth = total").select("i", "j", "conv_id")
    zero = F.lit(0).cast("long")
    ends = ends.union(conversations.filter("total = 0").select(zero, zero, "conv_id"))
    # All first turns have the root above them; the others look their parent up.
    parents = nodes.select(F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("conv_id").alias("found"))
    deep = nodes.filter("depth > 1").join(parents, ["pi", "pj"], "left").select("i", "j", F.col("found").alias("parent_conv_id"))
    rows = nodes.join(deep, ["i", "j"], "left").join(degrees, ["i", "j"], "left").join(totals, ["i", "j"])
    rows = rows.join(_end_digests(ends), ["i", "j"], "left")
    return rows.select(
        "conv_id", "depth",
        F.when(F.col("depth") == 1, F.lit(everyone["conv_id"]).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
