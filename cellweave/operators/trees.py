"""Forests of regression trees grown on histograms, for many trees and many folds at once.

Features are cut into at most 32 bins once.  Every tree draws its rows by Poisson weights from a hash of the row's key,
so trees do not depend on partitions.  Large nodes of all trees are divided level by level: tasks add the weights and
weighted labels of each node, feature and bin, the sums of all tasks meet by node, and only the chosen splits come to
the driver.  A node of no more than ``small`` rows is finished where its rows are gathered, to its last leaf and
without further passes.  A table of moderate size is thus read once for all trees of all folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .stats import Draws

BINS = 32
PASS = 20_000  # nodes whose histograms one pass adds
MODEL_MB = 800  # of all trees together, on the driver and in every task that scores


class Tree:
    """Flat nodes: ``feature`` (-1 in a leaf), ``bin`` (up to it goes left), ``left``, ``right``, ``value``."""

    def __init__(self) -> None:
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        a = len(self.feature)
        for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [x, x]
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, a, a + 1
        return a, a + 1

    def graft(self, node: int, arrays: tuple[np.ndarray, ...]) -> None:
        """Put a finished subtree in the place of a leaf."""
        feature, at, left, right, value = (x.tolist() for x in arrays)
        base = len(self.feature) - 1  # node 0 of the subtree takes the leaf's place
        moved = [i + base for i in range(len(feature))]
        moved[0] = node
        for i in range(1, len(feature)):
            for column, x in ((self.feature, feature[i]), (self.bin, at[i]), (self.left, moved[left[i]]), (self.right, moved[right[i]]), (self.value, value[i])):
                column.append(x)
        self.feature[node], self.bin[node], self.left[node], self.right[node], self.value[node] = feature[0], at[0], moved[left[0]], moved[right[0]], value[0]

    def packed(self) -> tuple[np.ndarray, ...]:
        kinds = (np.int16, np.uint8, np.int32, np.int32, np.float32)
        return tuple(np.array(x, k) for x, k in zip((self.feature, self.bin, self.left, self.right, self.value), kinds, strict=True))


def leaf_of(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of bins falls into."""
    feature, at, left, right, _ = tree
    node, open_ = np.zeros(len(x), np.int32), np.arange(len(x))
    while len(open_ := open_[feature[node[open_]] >= 0]):
        here = node[open_]
        node[open_] = np.where(x[open_, feature[here]] <= at[here], left[here], right[here])
    return node


def best_splits(w: np.ndarray, wy: np.ndarray, leaf: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For histograms (node, feature, bin): whether a split lowers the squared error, and the first best feature and bin."""
    lw, ly = np.cumsum(w, axis=2)[:, :, :-1], np.cumsum(wy, axis=2)[:, :, :-1]
    tw, ty = w.sum(axis=2)[:, :, None], wy.sum(axis=2)[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ly**2 / lw + (ty - ly) ** 2 / (tw - lw) - ty**2 / tw
    gain = np.where((lw >= leaf) & (tw - lw >= leaf), gain, -np.inf).reshape(len(w), -1)
    top = gain.max(axis=1)
    best = (gain >= near(top)[:, None]).argmax(axis=1)
    return top > least_gain(tw[:, 0, 0], ty[:, 0, 0]), best // lw.shape[2], best % lw.shape[2]


def near(top: np.ndarray) -> np.ndarray:
    """Gains from here on count as equal to the best, so the first feature and bin wins whatever the order of the sums."""
    return np.where(np.isfinite(top), top - 1e-9 * np.abs(top), top)


def least_gain(w: np.ndarray, wy: np.ndarray) -> np.ndarray:
    return 1e-9 * (1 + np.abs(wy) ** 2 / np.maximum(w, 1) * 1e-3)


def sorted_splits(at: np.ndarray, nodes: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: float, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for the rows of one task, every node with some: sorted by node and bin for each feature, so many small nodes cost no more than a few large ones."""
    key = (at[:, None] * bins + x).T
    order = np.argsort(key.astype(np.uint16) if nodes * bins <= 1 << 16 else key, axis=1, kind="stable")
    key = np.take_along_axis(key, order, 1)
    cw, cy = np.cumsum(w[order], axis=1), np.cumsum((w * y)[order], axis=1)
    count = np.bincount(at, minlength=nodes)
    end = np.cumsum(count)
    start, node = end - count, np.repeat(np.arange(nodes), count)
    before = lambda c: np.where(start > 0, c[:, start - 1], 0.0)
    bw, by = before(cw), before(cy)
    tw, ty = cw[:, end - 1] - bw, cy[:, end - 1] - by
    lw, ly = cw - bw[:, node], cy - by[:, node]
    with np.errstate(divide="ignore", invalid="ignore"):
        rw, ry = tw[:, node] - lw, ty[:, node] - ly
        gain = ly**2 / lw + ry**2 / rw - (ty**2 / tw)[:, node]
    last = np.ones(key.shape, bool)
    last[:, :-1] = key[:, :-1] != key[:, 1:]  # of its bin; the last of a node has nothing to its right
    last[:, end - 1] = False
    gain = np.where(last & (lw >= leaf) & (rw >= leaf), gain, -np.inf)
    by_node = np.maximum.reduceat(gain, start, axis=1)
    top = by_node.max(axis=0)
    feature = (by_node >= near(top)).argmax(axis=0)
    hits = np.flatnonzero(gain[feature[node], np.arange(len(node))] >= near(top)[node])
    first = hits[np.r_[True, node[hits][1:] != node[hits][:-1]]]
    return top > least_gain(tw[0], ty[0]), feature, key[feature, first] - np.arange(nodes) * bins


def histograms(node: np.ndarray, nodes: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weights and weighted values by node, feature and bin."""
    out = np.empty((2, nodes, x.shape[1], bins))
    for f in range(x.shape[1]):
        at = node * bins + x[:, f]
        for k, v in enumerate((w, w * y)):
            out[k, :, f] = np.bincount(at, v, nodes * bins).reshape(nodes, bins)
    return out[0], out[1]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, *, depth: int, leaf: float, bins: int = BINS) -> tuple[np.ndarray, ...]:
    """A whole tree on rows in memory, all nodes of a level at once."""
    tree = Tree()
    rows, level = np.arange(len(y)), [0]
    at = np.zeros(len(y), np.int64)  # place of a row's node in the level
    for d in range(depth + 1):
        total, sums = np.bincount(at, w[rows], len(level)), np.bincount(at, w[rows] * y[rows], len(level))
        for n, mean in zip(level, (sums / total).tolist(), strict=True):
            tree.value[n] = mean
        live = total >= 2 * leaf
        if d == depth or not live.any():
            break
        if not live.all():  # the others are leaves
            mine = live[at]
            rows, at, level = rows[mine], (np.cumsum(live) - 1)[at[mine]], [n for n, x in zip(level, live, strict=True) if x]
        split, feature, bin_ = sorted_splits(at, len(level), x[rows], y[rows], w[rows], leaf, bins)
        if not split.any():
            break
        kids = np.zeros(len(level), np.int64)
        following = []
        for i in np.flatnonzero(split):
            kids[i] = len(following)
            following += tree.split(level[i], int(feature[i]), int(bin_[i]))
        kept = split[at]
        rows, at = rows[kept], at[kept]
        at = kids[at] + (x[rows, feature[at]] > bin_[at])
        level = following
    return tree.packed()


class Forest:
    """Trees with the edges that put numbers into bins."""

    def __init__(self, names: list[str], edges: list[list[float]], middle: list[float], trees: list[tuple[np.ndarray, ...]]) -> None:
        self.names, self.edges, self.middle, self.trees = names, [np.array(e) for e in edges], middle, trees

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        filled = (np.where(np.isnan(c), m, c) for c, m in zip(columns, self.middle, strict=True))
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, filled, strict=True)], axis=1).astype(np.uint8)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees; nulls count as the feature's middle."""
        sent = df.sparkSession.sparkContext.broadcast(self)  # held to MODEL_MB when it was grown
        place = len(df.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = sent.value
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[place:]]
                x, total = forest.binned(columns), np.zeros(batch.num_rows)
                for tree in forest.trees:
                    total += tree[4][leaf_of(tree, x)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(total / max(1, len(forest.trees)))], [*batch.schema.names[:place], name])

        wide = df.select("*", *[F.col(n).cast("double").alias(f"_x{i}") for i, n in enumerate(self.names)])
        return wide.mapInArrow(run, df.withColumn(name, F.lit(0.0)).schema)


def fit_forests(df: DataFrame, names: list[str], masks: list[Column], *, label: str = "label", key: tuple[str, ...] = ("cell", "week"), trees: int = 300, depth: int = 30, leaf: int = 2, small: int = 200_000, seed: int = 42, bootstrap: bool = True) -> list[Forest]:
    """A forest for each of ``masks`` (which rows it learns from); all features are tried at every node.

    A leaf keeps rows of a total weight of at least ``leaf``.  Trees grow with the rows, so a forest of deep trees over
    very many rows is refused once it could exceed ``MODEL_MB``: a larger ``leaf`` or a lower ``depth`` bounds it.
    Rows without a label teach nothing; null features count as the feature's median.  Without rows a forest predicts 0.
    """
    spark = df.sparkSession
    numbers = [F.col(n).cast("double") for n in names]
    usable = df.where(F.col(label).isNotNull())
    shares = [k / BINS for k in range(1, BINS)]
    seen = usable.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"e{i}") for i, c in enumerate(numbers)], F.count("*").alias("n")).first()
    edges = [sorted(set(seen[f"e{i}"] or [])) for i in range(len(names))]
    middle = [float(seen[f"e{i}"][BINS // 2 - 1]) if seen[f"e{i}"] else 0.0 for i in range(len(names))]
    nodes = min(2 ** (depth + 1), 2 * seen.n // max(1, leaf) + 1)
    if nodes * 15 * trees * len(masks) > MODEL_MB * 1_000_000:
        raise ValueError(f"{trees * len(masks)} trees of up to {nodes} nodes exceed {MODEL_MB} MB: raise leaf or lower depth")
    shell = Forest(names, edges, middle, [])
    bits = sum((F.when(m, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(masks)), F.lit(0))
    light = usable.select(F.xxhash64(*key).alias("_h"), F.col(label).cast("double").alias("_y"), bits.cast("long").alias("_m"), *[c.alias(f"_x{i}") for i, c in enumerate(numbers)])

    def into_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shell.binned([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[3:]])
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["_h", "_y", "_m", "_x"])

    rows = cut(light.mapInArrow(into_bins, "_h long, _y double, _m long, _x binary"))
    wide = len(names)
    grown = [Tree() for _ in range(trees * len(masks))]

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bins, labels, masks and the weights for each tree of a forest, some rows at a time."""
        draws = Draws(trees, seed)
        h, y, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        x = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, wide)
        for a in range(0, len(y), 4096):
            b = min(a + 4096, len(y))
            yield x[a:b], y[a:b], m[a:b], draws.weights(h[a:b].view(np.uint64)) if bootstrap else np.ones((b - a, trees), np.int64)

    frontier = [(t, 0, int(seen.n)) for t in range(len(grown))]
    small_nodes: list[tuple[int, int]] = []
    for level in range(depth):
        large = [(t, n) for t, n, size in frontier if size > small]
        small_nodes += [(t, n) for t, n, size in frontier if size <= small]
        frontier = []
        for a in range(0, len(large), PASS):
            for t, n, feature, at, value, lw, rw in _divided(rows, grown, large[a : a + PASS], read, trees, wide, leaf):
                grown[t].value[n] = value
                if feature >= 0:
                    left, right = grown[t].split(n, feature, at)
                    frontier += [(t, left, lw), (t, right, rw)]
                    if level == depth - 1:
                        small_nodes += [(t, left), (t, right)]
        if not frontier:
            break
    for t, n, *arrays in _finished(rows, grown, small_nodes, read, trees, wide, depth, leaf):
        grown[t].graft(n, tuple(arrays))
    packed = [t.packed() for t in grown]
    return [Forest(names, [list(e) for e in shell.edges], middle, packed[k * trees : (k + 1) * trees]) for k in range(len(masks))]


def _taken(read, batch: pa.RecordBatch, grown: list, wanted: dict[int, list[int]], trees: int) -> Iterator[tuple]:
    """For each tree with wanted nodes: the tree, its rows (bins, labels, weights) in those nodes, and the place of each row's node."""
    for x, y, m, weights in read(batch):
        for t, nodes in wanted.items():
            fit, tree = divmod(t, trees)
            mine = np.flatnonzero((weights[:, tree] > 0) & ((m >> fit) & 1 == 1))
            at = leaf_of(grown[t], x[mine])
            place = np.searchsorted(nodes, at)
            there = np.flatnonzero((place < len(nodes)) & (np.array(nodes)[np.minimum(place, len(nodes) - 1)] == at))
            if len(there):
                yield t, x[mine[there]], y[mine[there]], weights[mine[there], tree].astype(np.float64), place[there]


def _wanted(nodes: list[tuple[int, int]]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for t, n in sorted(nodes):
        out.setdefault(t, []).append(n)
    return out


def _divided(rows: DataFrame, grown: list[Tree], nodes: list[tuple[int, int]], read, trees: int, wide: int, leaf: float) -> list[tuple]:
    """The best split of each node: (tree, node, feature or -1, bin, mean, rows to the left, to the right)."""
    wanted = _wanted(nodes)
    sent = rows.sparkSession.sparkContext.broadcast(({t: grown[t].packed() for t in wanted}, wanted))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = sent.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, x, y, w, place in _taken(read, batch, held, asked, trees):
                here, inside = np.unique(place, return_inverse=True)
                hw, hy = histograms(inside, len(here), x, y, w, BINS)
                for i, p in enumerate(here):
                    total = sums.setdefault((t, asked[t][p]), np.zeros((2, wide, BINS)))
                    total[0] += hw[i]
                    total[1] += hy[i]
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["t", "node", "sums"])

    def choose(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s, np.float64) for s in group.column("sums").to_pylist()).reshape(2, 1, wide, BINS)
        split, feature, at = best_splits(total[0], total[1], leaf)
        weight = total[0, 0, feature[0]] if split[0] else total[0, 0, 0]
        left = float(weight[: at[0] + 1].sum()) if split[0] else 0.0
        mean = float(total[1, 0, 0].sum() / max(weight.sum(), 1e-300))
        row = (key[0].as_py(), key[1].as_py(), int(feature[0]) if split[0] else -1, int(at[0]), mean, int(left), int(weight.sum() - left))
        return pa.table({n: [v] for n, v in zip(("t", "node", "feature", "bin", "mean", "lw", "rw"), row, strict=True)})

    partial = rows.mapInArrow(add, "t long, node long, sums binary")
    return [tuple(r) for r in partial.groupBy("t", "node").applyInArrow(choose, "t long, node long, feature long, bin long, mean double, lw long, rw long").collect()]  # a row for each node


def _finished(rows: DataFrame, grown: list[Tree], nodes: list[tuple[int, int]], read, trees: int, wide: int, depth: int, leaf: float) -> Iterator[tuple]:
    """The subtrees of small nodes: (tree, node, flat nodes), each grown by one task from its rows."""
    wanted = _wanted(nodes)
    sent = rows.sparkSession.sparkContext.broadcast(({t: grown[t].packed() for t in wanted}, wanted))
    deep = {(t, n): d for t in wanted for n, d in _depths(grown[t]).items()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = sent.value
        for batch in batches:
            out = []
            for t, x, y, w, place in _taken(read, batch, held, asked, trees):
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
                for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                    at = order[a:b]
                    out.append((t, asked[t][place[at[0]]], x[at].tobytes(), y[at].tobytes(), w[at].astype(np.uint8).tobytes()))
                if len(out) >= 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], fields)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], fields)

    kinds, fields = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), ["t", "node", "x", "y", "w"]
    arrays = (np.int16, np.uint8, np.int32, np.int32, np.float32)

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        t, node = key[0].as_py(), key[1].as_py()
        x, y, w = (np.frombuffer(b"".join(group.column(c).to_pylist()), k) for c, k in (("x", np.uint8), ("y", np.float64), ("w", np.uint8)))
        tree = grow(x.reshape(-1, wide), y, w.astype(np.float64), depth=depth - deep[t, node], leaf=leaf)
        return pa.table({"t": [t], "node": [node], **{f"a{i}": pa.array([a.tobytes()], pa.binary()) for i, a in enumerate(tree)}})

    packed = rows.mapInArrow(gather, "t long, node long, x binary, y binary, w binary")
    tasks = max(1, min(len(nodes), 4 * rows.sparkSession.sparkContext.defaultParallelism))  # growing is much work for few bytes
    done = packed.repartition(tasks, "t", "node").groupBy("t", "node").applyInArrow(finish, "t long, node long, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary")
    for r in done.collect():  # the model, held to MODEL_MB
        yield r.t, r.node, *[np.frombuffer(r[f"a{i}"], k) for i, k in enumerate(arrays)]


def _depths(tree: Tree) -> dict[int, int]:
    out, todo = {}, [(0, 0)]
    while todo:
        n, d = todo.pop()
        out[n] = d
        if tree.feature[n] >= 0:
            todo += [(tree.left[n], d + 1), (tree.right[n], d + 1)]
    return out
