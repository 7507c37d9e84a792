"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each level every child draws an
exponential variate -ln(u) / weight, where u is a hash of the row's key and the
child's own name; the smallest draw wins.  A child's chance is its share of the
weight, and a child's draw depends on nothing but its name and weight.  So when
weights change below one node, rows move only into or out of that subtree, and
a new subtree only takes rows, from everywhere in proportion.

``grown`` adds a shard as a subtree of its own, which makes the law ``key``
exact: no row moves between shards that were there before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusterio import cut
from .ranking import gapless

#: region -> rack -> shard -> weight; names of racks are unique over all regions.
Tree = dict[str, dict[str, dict[int, float]]]


def uniform_tree(shards: int = 40, regions: int = 4, racks: int = 2) -> Tree:
    """Shards 0, 1, ... of weight 1 dealt evenly over racks in regions."""
    tree: Tree = {}
    for s in range(shards):
        at = s * regions * racks // shards
        tree.setdefault(f"r{at // racks}", {}).setdefault(f"r{at // racks}k{at % racks}", {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region and a rack of its own."""
    new = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return {**tree, f"grown{new}": {f"grown{new}k0": {new: weight}}}


def _winner(key: Column, children: dict[str, float]) -> Column:
    """The child whose weighted draw is least; the first by name if two are equal."""
    tries = []
    for name, weight in sorted(children.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
        tries.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*tries))["name"] if len(tries) > 1 else F.lit(next(iter(children)))


def _by_parent(parent: Column, choices: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, choice in choices.items():
        out = F.when(parent == name, choice).otherwise(out)
    return out


def descend(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """``df`` with ``name``, the shard that each row's key reaches; a null key is hashed like any other value.

    Nodes of no weight are never reached.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    weights = {region: {rack: sum(shards.values()) for rack, shards in racks.items() if sum(shards.values()) > 0} for region, racks in tree.items()}
    live = {region: racks for region, racks in weights.items() if racks}
    leaves = {rack: {str(s): w for s, w in tree[region][rack].items() if w > 0} for region, racks in live.items() for rack in racks}
    region, rack = f"_{name}_region", f"_{name}_rack"
    df = df.withColumn(region, _winner(key, {r: sum(racks.values()) for r, racks in live.items()}))
    df = df.withColumn(rack, _by_parent(F.col(region), {r: _winner(key, racks) for r, racks in live.items()}))
    return df.withColumn(name, _by_parent(F.col(rack), {k: _winner(key, shards) for k, shards in leaves.items()}).cast("int")).drop(region, rack)


def assign(docs: DataFrame, tree: Tree, *, key: str = "doc_id", text: str = "text", splits: int = 64) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    Size is the UTF-8 bytes of the text plus 16; null texts count as empty.  Repeated rows go to the same shard and
    get slots of their own; an empty table has no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    rows = descend(descend(rows, F.col(key), tree, "shard"), F.col(key), grown(tree), "grown_shard")
    rows = cut(rows)  # without texts; used twice below
    return gapless(rows, "shard", [key, "text_crc32", "size"], [key, "text_crc32", "size"], splits=splits)
