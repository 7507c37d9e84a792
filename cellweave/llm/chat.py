"""Chat formatting into one packed stream over the prefix tree of all conversations.

Conversations that begin with the same turns share nodes.  A node's name is the
digest of its turn and of its parent's name.  Nodes that follow each other with
no fork between them are one chain; the key of a chain names the heads of all
chains down to it, so keys grow with the forks on the way and not with the
turns.  Bytewise order of (key, depth) is depth-first order, so the tree needs
no building: a range-partitioned sort and a prefix sum of lengths lay every node
out once, also below a first turn that very many conversations share.  A node
gets its place in the stream, the position id at which its tokens start (the
length of its ancestors), the stream intervals of its ancestors (one for each
chain, since a chain lies in one piece), which with its own causal part are all
that it may attend to, and the part of it that carries loss.  Tokens are code
points.

Template: ``<|turn|>role\\ntext<|end|>\\n``.  Inside roles and texts a backslash
is doubled and control strings get a backslash after their first character, so
no text can end or start a turn and the original comes back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusterio import cut, sent_if_few

OPEN, END = "<|turn|>", "<|end|>\n"
DIGEST = 12
FEW = 200_000  # forks that are broadcast, 24 characters each
HOT = 10_000  # conversations that look up one chain in one task
CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def segment(role: str, text: str) -> tuple[str, int]:
    """One formatted turn, and where its text begins."""
    head = f"{OPEN}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest.removesuffix(END))))
    return turns


def turns_of(conversations: DataFrame) -> DataFrame:
    """Formatted turns of every conversation, rows ordered by turn (then role and text, if turn numbers repeat).

    Null roles and texts are empty; a null conv_id is one more conversation; columns beside the four are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node, position = "", 0
                for depth, t in enumerate(turns):
                    formatted, at = segment(t["role"], t["text"])
                    parent, node = node, hashlib.blake2b((node + formatted).encode(), digest_size=DIGEST).hexdigest()
                    loss = (at, len(formatted) - len(END)) if t["role"] == "assistant" else (None, None)
                    rows.append((conv, depth, depth == len(turns) - 1, parent, node, position, formatted, *loss))
                    position += len(formatted)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["conv_id", "depth", "leaf", "parent", "node", "position", "segment", "loss_from", "loss_to"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", empty("role"), empty("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.mapInArrow(run, "conv_id long, depth long, leaf boolean, parent string, node string, position long, segment string, loss_from long, loss_to long")


def chains_of(turns: DataFrame, *, few: int = FEW) -> DataFrame:
    """``turns`` without texts, with ``chain``: the heads of all chains down to a turn, the outermost first.

    A first turn, and a turn whose parent has several children, is the head of a chain.
    """
    light = turns.select("conv_id", "depth", "leaf", "parent", "node")
    several = light.where("depth > 0").groupBy("parent").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    forks = cut(several.where("a < b").select(F.col("parent").alias("fork")))
    forks = sent_if_few(forks, few)
    told = light.join(forks, light.parent == forks.fork, "left")
    head = F.when(F.col("fork").isNotNull() | (F.col("depth") == 0), F.col("node"))
    down = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    return told.select("conv_id", "depth", "leaf", "node", F.array_join(F.collect_list(head).over(down), "").alias("chain"))


class Open:
    """The chains from the root to a place in the stream, as (key, start, end so far), outermost first."""

    def __init__(self, chains: list[tuple[str, int, int]] = ()) -> None:
        self.chains = list(chains)

    def enter(self, chain: str, start: int, end: int) -> None:
        """Go on to a piece of ``chain`` that follows in depth-first order."""
        while self.chains and not chain.startswith(self.chains[-1][0]):
            self.chains.pop()
        if self.chains and self.chains[-1][0] == chain:
            start = self.chains.pop()[1]
        self.chains.append((chain, start, end))


def layout(turns: DataFrame, keyed: DataFrame) -> DataFrame:
    """The nodes of the prefix tree, each once, in depth-first order of one stream.

    Columns: chain, depth, chain_start (where the node's chain starts in the stream), start, end (of the node),
    position (id of its first token), ancestors (the stream intervals that hold them, outermost first), segment (its
    tokens), loss_from and loss_to (its part under loss, null if none).  Each written row carries the number of the
    range partition that it is in, so the places do not depend on how the result is read, coalesced or joined.  Empty
    texts are nodes of their marks alone; no conversations give no nodes.
    """
    spark = turns.sparkSession
    first = lambda *names: [F.first(c).alias(c) for c in names]
    texts = turns.groupBy("node").agg(*first("position", "segment", "loss_from", "loss_to"))
    places = keyed.groupBy("node").agg(*first("chain", "depth"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = places.join(texts, "node").select("chain", "depth", "position", "segment", "loss_from", "loss_to")
    ranged = joined.repartitionByRange(partitions, "chain", "depth").sortWithinPartitions("chain", "depth")
    nodes = cut(ranged.select("*", F.spark_partition_id().cast("long").alias("part")))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, stack = -1, 0, Open()
        for batch in batches:
            for part, chain, n in zip(*(batch.column(c).to_pylist() for c in ("part", "chain", "n")), strict=True):
                stack.enter(chain, at, at + n)
                at += n
        if part < 0:
            return
        keys, starts, ends = (list(c) for c in zip(*stack.chains, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int64()), (at, pa.int64()), (keys, pa.list_(pa.string())), (starts, pa.list_(pa.int64())), (ends, pa.list_(pa.int64())))], ["part", "total", "keys", "starts", "ends"])

    sized = nodes.select("part", "chain", F.length("segment").cast("long").alias("n"))
    sums = {r.part: r for r in sized.mapInArrow(measure, "part long, total long, keys array<string>, starts array<long>, ends array<long>").collect()}  # a row for each partition
    carry, base, stack = {}, 0, Open()
    for part in sorted(sums):
        carry[part] = (base, list(stack.chains))
        r = sums[part]
        for key, s, e in zip(r.keys, r.starts, r.ends, strict=True):
            stack.enter(key, base + s, base + e)
        base += r.total
    sent = spark.sparkContext.broadcast(carry)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, stack = 0, None, Open()
        for batch in batches:
            heads, starts, ends, ancestors = [], [], [], []
            for part, chain, text in zip(*(batch.column(c).to_pylist() for c in ("part", "chain", "segment")), strict=True):
                if part != inside:  # rows of a partition follow each other in order, also where a task reads several
                    at, before = sent.value[part]
                    inside, stack = part, Open(before)
                stack.enter(chain, at, at + len(text))
                *above, (_, head, _) = stack.chains
                ancestors.append([{"start": s, "end": e} for _, s, e in above] + ([{"start": head, "end": at}] if head < at else []))
                heads.append(head)
                starts.append(at)
                at += len(text)
                ends.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in (heads, starts, ends)], pa.array(ancestors, spans)], [*batch.schema.names[:-1], "chain_start", "start", "end", "ancestors"])

    schema = "chain string, depth long, position long, segment string, loss_from long, loss_to long, chain_start long, start long, end long, ancestors array<struct<start:long,end:long>>"
    return nodes.mapInArrow(place, schema)


def read_back(nodes: DataFrame, leaves: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Each conversation as its leaf's attention intervals select it from the stream: conv_id and its pieces in order.

    ``leaves`` has conv_id and the chain and depth of the last turn.  Every interval starts where a chain does, so the
    nodes in it are found by that start.  Where more than ``hot`` conversations want one chain, as below a common first
    turn, they are dealt over parts of about that size, and the chain's nodes go to each.  A conversation without rows
    in ``leaves`` is not there; one with an empty text reads back as empty.
    """
    above = F.filter("ancestors", lambda x: x["start"] != F.col("chain_start"))
    own = F.array(F.struct(F.col("chain_start").alias("start"), "end"))
    seen = nodes.select("chain", "depth", F.concat(above, own).alias("seen"))
    wanted = leaves.join(seen, ["chain", "depth"]).select("conv_id", F.explode("seen").alias("at")).select("conv_id", F.col("at.start").alias("from"), F.col("at.end").alias("upto"))
    crowds = cut(wanted.groupBy("from").count().where(F.col("count") > hot).select(F.col("from").alias("chain_start"), F.ceil(F.col("count") / hot).alias("parts")))
    if crowds.isEmpty():
        wanted, held = wanted.withColumn("salt", F.lit(0)), nodes.withColumn("salt", F.lit(0))
    else:
        crowds = sent_if_few(crowds)
        wanted = wanted.join(crowds, F.col("from") == F.col("chain_start"), "left").select("conv_id", "from", "upto", F.pmod(F.xxhash64("conv_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
        held = nodes.join(crowds, "chain_start", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)))
    held = held.select("chain_start", "salt", "start", "segment", "loss_from", "loss_to").alias("h")
    pieces = wanted.alias("w").join(held, (F.col("w.from") == F.col("h.chain_start")) & (F.col("w.salt") == F.col("h.salt")) & (F.col("h.start") < F.col("w.upto")))
    return pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "loss_from", "loss_to"))).alias("pieces"))


def digests(read: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, from its formatted text and its loss mask alone."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                formatted = "".join(p["segment"] for p in pieces)
                turns = parse(formatted)
                loss = "".join(unescape(p["segment"][p["loss_from"] : p["loss_to"]]) for p in pieces if p["loss_from"] is not None)
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(conversations: DataFrame, *, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """The nodes of the packed stream, and conv_id with the chain and depth of its last node."""
    turns = cut(turns_of(conversations))
    keyed = cut(chains_of(turns, few=few))
    return layout(turns, keyed), keyed.where("leaf").select("conv_id", "chain", "depth")
