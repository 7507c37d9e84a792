"""The prefix tree of conversations, with counts of every subtree, from adaptive radix trees.

A turn's id is the first 128 bits of the SHA-256 of its role and text, and a conversation's key the big-endian ids of
its turns one after another, so keys in bytewise order are the prefix tree in depth-first order.  (Two of n turns share
an id with a chance of about n^2 / 2^129.)  Keys, with the conversation's id behind them, are sorted over range
partitions; a task puts those of a partition into a radix tree (:mod:`.radix`), whose nodes lie at any byte, and gives
out a node only at depths of whole turns.

Nodes whose conversations all lie in one partition are final there.  The others are the turns that the last key of a
partition shares with the first of the next, so there are at most partitions x depth of them; every partition gives
its part of their sums.  In the order (first partition, depth) the descendants of such a node follow it up to its last
partition, so sums over subtrees are differences of running sums.  Equal conversations, however many, are spread over
partitions by their ids; the list of those that end in one node is written in parts and hashed part after part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusterio import cut, sent_if_few
from .radix import Tree

WIDTH = 16  # bytes of a turn's id
PER_PART = 50_000  # conversations in a partition, about
LISTED = 250  # ids in one written part of a list
NOTHING = hashlib.sha256(b"").hexdigest()
FINAL, SHARED, ENDS = 0, 1, 2
FIELDS = (
    ("kind", "int", pa.int32()), ("node", "string", pa.string()), ("parent", "string", pa.string()), ("part", "long", pa.int64()), ("depth", "long", pa.int64()), ("conv_id", "long", pa.int64()), ("parent_conv_id", "long", pa.int64()),
    ("n_convs", "long", pa.int64()), ("n_children", "long", pa.int64()), ("n_leaves", "long", pa.int64()), ("saved_tokens", "long", pa.int64()), ("chars", "long", pa.int64()), ("ends", "string", pa.string()),
)


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn as 32 hexadecimal digits; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (id, chars) by turn, null first, then by id where turn numbers repeat.

    Null roles and texts are empty; rows without a conv_id belong to no conversation.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", turn_id(empty("role"), empty("text")).alias("id"), F.length(empty("text")).alias("chars"))
    gathered = conversations.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def with_heads(convs: DataFrame, donor: Column, taken: Column, most: int) -> DataFrame:
    """Each conversation with its first ``taken`` (at most ``most``) turns replaced by as many of the conversation ``donor``'s: all that it has if fewer, none if it is absent."""
    heads = convs.select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, most).alias("_head"))
    asked = convs.withColumns({"_from": donor, "_taken": taken})
    joined = asked.join(heads, F.col("_from") == F.col("_donor"), "left")
    first = F.coalesce(F.slice("_head", F.lit(1), F.col("_taken")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_taken") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def keyed(convs: DataFrame) -> DataFrame:
    """``conv_id``, ``key`` (the turns' ids) and ``chars`` (the code points of their texts)."""
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    return convs.select("conv_id", F.unhex(ids).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = 0
    while (n + 1) * WIDTH <= min(len(a), len(b)) and a[n * WIDTH : (n + 1) * WIDTH] == b[n * WIDTH : (n + 1) * WIDTH]:
        n += 1
    return n


def borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition the turns that its first key shares with the last one before, and its last with the next; -1 where there is none.

    A row of two keys for each partition is compared, and one of two numbers for each comes to the driver.
    """
    ends = rows.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    beside = ends.select("part", "first", F.lag("last").over(W.orderBy("part")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, before = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            depth = [-1 if b is None else shared_turns(a, b) for a, b in zip(first, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(depth, pa.int64())], ["part", "depth"])

    left = {r.part: r.depth for r in beside.mapInArrow(run, "part long, depth long").collect()}
    order = sorted(left)
    return {p: (left[p], left[after] if after is not None else -1) for p, after in zip(order, [*order[1:], None], strict=False)}


def names(key: bytes, depth: int) -> list[str]:
    """The names of the nodes on the way to ``depth`` turns of a key, the root's first."""
    so_far, out = hashlib.blake2b(digest_size=WIDTH), []
    for k in range(depth + 1):
        out.append(so_far.copy().hexdigest())
        so_far.update(key[k * WIDTH : (k + 1) * WIDTH])
    return out


def nodes_of(part: int, keys: list[bytes], convs: list[list[int]], chars: list[list[int]], left: int, right: int) -> list[tuple]:
    """The nodes of one partition's sorted keys, as rows of ``FIELDS``.

    Those of at most ``left`` turns on the first key's way, and of at most ``right`` on the last key's, are shared with
    other partitions: their rows have this partition's part of the sums, over nodes that are not shared alone.
    """
    tree = Tree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    walk, last = tree.walk(), len(keys) - 1
    ways = names(keys[0], max(left, 0)), names(keys[last], max(right, 0))
    size = len(walk)
    n, least, tops, leaves, saved, low, high = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size, [last] * size, [0] * size
    waiting: list[list[list]] = [[] for _ in range(size)]  # nodes whose parent is further up
    rows: list = []
    for at in range(size - 1, -1, -1):
        node, above, end = walk[at]
        ends = convs[node.value] if node.value is not None else []
        if ends:
            n[at] += len(ends)
            least[at] = ends[0] if least[at] is None else min(least[at], ends[0])
            low[at], high[at] = min(low[at], node.value), max(high[at], node.value)
        start = walk[above][2] + 1 if above >= 0 else 0
        for depth in range(end // WIDTH, -(-start // WIDTH) - 1, -1):
            here = ends if depth * WIDTH == end else []
            tokens = chars[low[at]][depth - 1] if depth else 0
            on_first, on_last = low[at] == 0 and depth <= left, high[at] == last and depth <= right
            if on_first or on_last:
                way = ways[0] if on_first else ways[1]
                for row in waiting[at]:
                    row[2] = way[depth]
                rows.append((SHARED, way[depth], way[depth - 1] if depth else None, part, depth, least[at], None, n[at], tops[at], leaves[at], saved[at], tokens, None))
                for k in range(0, len(here), LISTED):
                    rows.append((ENDS, way[depth], None, part, k, None, None, None, None, None, None, None, ",".join(map(str, here[k : k + LISTED]))))
                waiting[at], tops[at] = [], 0
            else:
                leaves[at] = leaves[at] or 1
                saved[at] += (n[at] - 1) * tokens
                for row in waiting[at]:
                    row[6] = least[at]
                told = hashlib.sha256(",".join(map(str, here)).encode()).hexdigest()
                row = [FINAL, None, None, part, depth, least[at], None, n[at], tops[at], leaves[at], saved[at], None, told]
                rows.append(row)
                waiting[at], tops[at] = [row], 1
        if above >= 0:
            n[above] += n[at]
            least[above] = least[at] if least[above] is None else min(least[above], least[at])
            tops[above] += tops[at]
            leaves[above] += leaves[at]
            saved[above] += saved[at]
            low[above], high[above] = min(low[above], low[at]), max(high[above], high[at])
            waiting[above] += waiting[at]
            waiting[at] = []
    return rows


def _parts(rows: DataFrame, sides: dict[int, tuple[int, int]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(sides)  # two numbers for each partition

    def told(part: int, keys: list, convs: list, chars: list) -> Iterator[pa.RecordBatch]:
        found = nodes_of(part, keys, convs, chars, *sent.value[part])
        for k in range(0, len(found), 10_000):
            columns = zip(*found[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, FIELDS, strict=True)], [name for name, _, _ in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, convs, chars = -1, [], [], []
        for batch in batches:
            for p, key, conv, sizes in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "conv_id", "chars")), strict=True):
                if p != part and keys:
                    yield from told(part, keys, convs, chars)
                    keys, convs, chars = [], [], []
                part = p
                if keys and keys[-1] == key:
                    convs[-1].append(conv)
                else:
                    keys.append(key)
                    convs.append([conv])
                    chars.append(sizes)
        if keys:
            yield from told(part, keys, convs, chars)

    return rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in FIELDS))


def _lists(parts: DataFrame) -> DataFrame:
    """The digest of the joined parts of each list, read one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, so_far = None, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([inside], pa.string()), pa.array([so_far.hexdigest()])], ["node", "ends"])
        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != inside:
                    if inside is not None:
                        yield done()
                    inside, so_far = node, hashlib.sha256()
                else:
                    so_far.update(b",")
                so_far.update(ids.encode())
        if inside is not None:
            yield done()

    return parts.repartition("node").sortWithinPartitions("node", "part", "depth").select("node", "ends").mapInArrow(run, "node string, ends string")


def _whole(shared: DataFrame, parts: DataFrame, lists: DataFrame) -> DataFrame:
    """The shared nodes with the sums of their whole subtrees."""
    made = shared.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("part").alias("p1"), F.max("part").alias("p2"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    kids = made.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_kids"))
    made = made.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0))).drop("_kids")
    made = cut(made.withColumns({"_leaf": (F.col("n_children") == 0).cast("long"), "_saved": (F.col("n_convs") - 1) * F.col("chars")}))
    above = W.partitionBy("p1").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = made.withColumns({f"{c}_to": F.sum(c).over(above) for c in ("_leaf", "_saved")})
    begun = made.groupBy(F.col("p1").alias("part")).agg(*[F.sum(c).alias(c) for c in ("_leaf", "_saved")])
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    sums = parts.join(begun, "part", "left").select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_leaf", "_saved")])
    side = lambda p: sent_if_few(cut(sums.select(F.col("part").alias(p), *[F.col(c).alias(f"{c}_{p}") for c in ("_leaf", "_saved")])))
    told = inside.join(side("p1"), "p1").join(side("p2"), "p2")
    total = lambda c: F.col(c) + F.col(f"{c}_p2") - F.col(f"{c}_p1") - F.col(f"{c}_to")
    out = told.withColumns({"n_leaves": F.col("n_leaves") + total("_leaf"), "saved_tokens": F.col("saved_tokens") + total("_saved")})
    out = out.join(lists, "node", "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
    up = out.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return cut(out.join(up, "parent", "left"))


def prefix_nodes(convs: DataFrame, *, per_part: int = PER_PART) -> DataFrame:
    """The nodes of the prefix tree of ``convs`` (``conv_id``, no id twice, ``key`` and ``chars`` of :func:`keyed`).

    A row for each distinct sequence of first turns, the empty one included: ``conv_id`` (the least that begins so),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in its subtree, it
    among them), ``saved_tokens`` (over the subtree, one less than the conversations times the code points of the last
    text) and ``ends_sha256`` (of the ids of conversations that end there, ascending, joined by commas).  Conversations
    without turns end in the root; no conversations give no nodes.  One conversation's ids are in one row.
    """
    spark = convs.sparkSession
    light = cut(convs)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-light.count() // per_part))
    ranged = light.repartitionByRange(partitions, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = cut(ranged.withColumn("part", F.spark_partition_id().cast("long")))
    found = cut(_parts(rows, borders(rows)))
    shared, final = found.where(F.col("kind") == SHARED), found.where(F.col("kind") == FINAL)
    whole = _whole(shared, cut(rows.select("part").distinct()), _lists(found.where(F.col("kind") == ENDS)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    above = sent_if_few(whole.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv")))
    told = final.join(above, F.col("parent") == F.col("_node"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))
    return told.select(*columns).unionByName(whole.select(*columns))
