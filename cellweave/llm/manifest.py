"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one above the groups' roots.

A leaf is the digest of a row's fields.  The leaves of a group stand in order; as long as several nodes remain,
every sixteen that follow each other (the last run may have fewer, even one) become the digest of their digests.
The roots of the groups, in order, make the root of all in the same way.

Witnesses grow while leaves are appended.  :class:`Frontier` keeps the open subtrees; each leaf below one has a
partial witness, which every later completion of a run of siblings extends.  A block of ``FAN ** LEVELS`` leaves that
is aligned with the tree is appended in one task, so the blocks of a large group run side by side; the roots of the
blocks are then appended in the same way, block after block, until a group has one root, and the groups' roots after
them.  On the way down a block's witness, which holds for all of its leaves, is added to theirs.  No task holds more
than a block, and nothing but the root comes to the driver.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clusterio import cut
from .ranking import in_order

FAN = 16
LEVELS = 3  # a block has FAN ** LEVELS leaves
STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of a row's fields: each is ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[told(c.cast("string")) for c in fields]), 256)


def proof_of(path: Column) -> Column:
    """The digest of all siblings on the way up, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its witness."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


class Frontier:
    """The open subtrees of a tree that is appended to, with a partial witness for every leaf.

    ``open[k]`` has the nodes of level k that have no parent yet, each with the range of leaves below it.  A run of
    ``FAN`` nodes, or what is left at the end, is completed at once: the witnesses below each of its nodes get the
    digests of the others, and the parent is attached one level higher.
    """

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, int]]] = []
        self.made: list[int] = []
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._attach(0, (digest, at, at + 1))

    def _attach(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
            self.made.append(0)
        self.open[level].append(node)
        self.made[level] += 1
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            step = "".join(digests[:k]), "".join(digests[k + 1 :])
            for witness in self.witness[first:end]:
                witness.append(step)
        self._attach(level + 1, (digest_of("".join(digests)), run[0][1], run[-1][2]))

    def finish(self, levels: int | None = None) -> str:
        """The one node that remains; or, for a block of a larger tree, its node ``levels`` above the leaves."""
        level = 0
        while level != levels if levels is not None else self.made[level] > 1:
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def _appended(block: pa.Table, levels: int) -> tuple[pa.Table, Frontier, str]:
    """The rows of a block in order, their witnesses inside it, and its root."""
    block = block.sort_by("at")
    tree = Frontier()
    for digest in block.column("digest").to_pylist():
        tree.append(digest)
    return block, tree, tree.finish(levels if block.column("total")[0].as_py() > FAN**levels else None)


def _block(levels: int) -> Column:
    return F.floor(F.col("at") / FAN**levels).cast("long")


def block_roots(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The root of every block, as the rows that are appended next: ``grp``, ``at``, ``total``, ``digest``."""

    def run(block: pa.Table) -> pa.Table:
        block, _, root = _appended(block, levels)
        at, total = block.column("at")[0].as_py(), block.column("total")[0].as_py()
        size = FAN**levels
        row = {"grp": block.column("grp")[:1].combine_chunks(), "at": pa.array([at // size]), "total": pa.array([-(-total // size)]), "digest": pa.array([root])}
        return pa.table(row)

    light = rows.select("grp", "at", "total", "digest", _block(levels).alias("_block"))
    return light.groupBy("grp", "_block").applyInArrow(run, "grp string, at long, total long, digest string")


def extended(rows: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot`` and ``path``: their witnesses inside the block, then the block's own from ``above``
    (``grp``, ``at`` of the block, ``subroot``, ``path``)."""
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField("subroot", T.StringType()), T.StructField("path", T.ArrayType(STEP))])

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        block, tree, _ = _appended(block, levels)
        upper = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()]
        steps = [s for w in tree.witness for s in (*w, *upper)]
        ends = [0]
        for w in tree.witness:
            ends.append(ends[-1] + len(w) + len(upper))
        left, right = ([s[k] for s in steps] for k in (0, 1))
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        subroot = pa.array([above.column("subroot")[0].as_py()] * len(block), pa.string())
        return block.select([f.name for f in fields]).append_column("subroot", subroot).append_column("path", path)

    left = rows.withColumn("_block", _block(levels)).groupBy("grp", "_block")
    return left.cogroup(above.withColumnRenamed("at", "_block").groupBy("grp", "_block")).applyInArrow(run, schema)


def _tiers(rows: DataFrame, levels: int) -> list[DataFrame]:
    """``rows``, the roots of their blocks, the roots of those ..., until every group has one."""
    tiers = [rows]
    while True:
        tiers.append(cut(block_roots(tiers[-1], levels)))
        if tiers[-1].where("total > 1").isEmpty():
            return tiers


def _down(tiers: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Witnesses of the lowest tier, from those of the single roots in ``top``."""
    above = top
    for k, rows in reversed(list(enumerate(tiers[:-1]))):
        above = extended(rows, above, levels)
        if k:
            above = cut(above.select("grp", "at", "subroot", "path"))
    return above


def witnessed(rows: DataFrame, group: str, order: list[str], digest: str = "leaf", *, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot`` (of their group), ``root`` (of all) and ``path``: the siblings on the way from their
    leaf to the root, for each level those to the left and to the right of it as one string of digests.

    Groups are ordered bytewise by their text, null first, and rows by ``order``, nulls first; equal places are decided
    by the digest, so repeated rows change nothing.  An empty table has no root and gives no rows.  ``rows`` are light:
    ids and digests.  Columns named grp, at, total, digest, subroot, root, path or _block are not taken.
    """
    spark = rows.sparkSession
    keyed = rows.withColumns({"grp": F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")), "digest": F.col(digest)})
    leaves = cut(in_order(cut(keyed), "grp", [*order, "digest"]))
    tiers = _tiers(leaves, levels)
    subroots = cut(tiers[-1].select(F.lit("").alias("all"), F.col("grp").alias("member"), "digest"))
    forest = cut(in_order(subroots, "all", ["member"]).withColumnRenamed("all", "grp"))
    upper = _tiers(forest, levels)
    root = next((r.digest for r in upper[-1].collect()), None)  # one row
    nothing = F.array().cast(T.ArrayType(STEP))
    seeds = upper[-1].select("grp", "at", F.lit(None).cast("string").alias("subroot"), nothing.alias("path"))
    tops = _down(upper, seeds, levels).select(F.col("member").alias("grp"), F.lit(0).cast("long").alias("at"), F.col("digest").alias("subroot"), "path")
    out = _down(tiers, cut(tops), levels)
    return out.withColumn("root", F.lit(root)).select(*[F.col(f"`{c}`") for c in rows.columns], "subroot", "root", "path")


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """For each row: ``key``, ``leaf``, ``subroot``, ``root``, ``path``, and ``shown``, the leaf of the row as it is now.

    ``tampered`` gives another text for rows that were changed after the tree was built, else null; their ``shown``
    is the leaf with that text.  Null fields are ``-``; a null key comes first in its group; a null group is one more.
    """
    c = {f: F.col(f"`{f}`") for f in {*fields, key, group}}
    changed = F.lit(None).cast("string") if tampered is None else tampered
    text = fields[-1]
    again = leaf_of(*[changed if f == text else c[f] for f in fields])
    leaf = leaf_of(*[c[f] for f in fields])
    rows = docs.select(c[key].alias("_key"), c[group].alias("_group"), leaf.alias("leaf"), F.when(changed.isNotNull(), again).alias("_again"))
    out = witnessed(rows, "_group", ["_key"], levels=levels)
    return out.select(F.col("_key").alias(key), "leaf", "subroot", "root", "path", F.coalesce("_again", "leaf").alias("shown"))
