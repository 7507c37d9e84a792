"""Removal of long repeats with enhanced suffix arrays over content-chosen anchors.

Every window of ``length`` bytes picks one anchor: its k-gram of least hash, the
first on ties.  The choice depends on the window's bytes alone, so equal windows
pick anchors at the same place, and two occurrences of a string always meet
under one anchor.  Around an anchor lies its context, the bytes of all windows
that may have picked it.

1. Tasks choose the anchors of their texts.  Contexts that occur twice within a
   batch are repeats already and send one row on, so frequent passages and copies
   shrink before the shuffle.
2. One shuffle by anchor tells the contexts that occur again (these are repeats
   as a whole) from those that stand alone beside others of the same anchor.
3. Only for the latter the bytes are fetched.  The contexts of an anchor, cut at
   it, form a suffix array with its table of common prefixes; a stack scan walks
   its interval tree.  In each interval the parts before the anchor are sorted
   backwards and compared: where they differ, left extension ends.  Members whose
   common bytes before and after the anchor reach ``length`` form a repeat group
   with all its occurrences.

Every row keeps its own repeats, as byte ranges; nothing is capped.  An anchor with
very many different contexts does not gather them in one task: all windows of its
contexts are hashed and counted, with the counts combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bytespans as B
from .clusterio import cut, fresh, own

GRAM = 41  # bytes of an anchor, fewer if the length asked for is short


def _gram(length: int) -> int:
    return min(GRAM, max(1, length // 2))


def choose(texts: B.Texts, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of a batch: text, place, context start and end (over the batch), hash of anchor and of context."""
    data, offs, k = texts.data, texts.offs, _gram(length)
    span = length - k + 1  # k-grams of a window
    size = np.diff(offs)
    n = len(data)
    if not (size >= length).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    spans = B.SpanHash(B.BYTE_CODE[data])
    start = np.arange(n - k + 1)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    least = (spans.of(start, start + k) & ~low) | start.astype(np.uint64)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    whole = np.zeros(len(least) + 1, np.int64)
    long = np.flatnonzero(size >= length)
    np.add.at(whole, offs[long], 1)
    np.add.at(whole, offs[long + 1] - length + 1, -1)
    picked = (least[np.cumsum(whole[:-1]) > 0] & low).astype(np.int64)  # never decreases
    place = picked[np.append(True, picked[1:] != picked[:-1])]
    doc = np.searchsorted(offs, place, "right") - 1
    left, right = np.maximum(offs[doc], place - span + 1), np.minimum(offs[doc + 1], place + length)
    return doc, place, left, right, spans.of(place, place + k), spans.of(left, right) ^ B.mix((place - left).astype(np.uint64))


def _pack(place, before, after, multi, done):
    return (place << 24) | (before << 14) | (after << 2) | (multi << 1) | done


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t"):
            texts = B.Texts(batch.column("t"))
            key = batch.column("rk").to_numpy(zero_copy_only=False)
            doc, place, left, right, anchor, context = choose(texts, length)
            if not len(doc):
                continue
            both = B.mix(anchor ^ B.mix(context))
            order = np.argsort(both, kind="stable")
            new = np.append(True, both[order[1:]] != both[order[:-1]])
            multi = np.zeros(len(doc), bool)
            multi[order] = ~new | np.append(~new[1:], False)
            first = np.zeros(len(doc), bool)
            first[order] = new
            done = multi.astype(np.int64)
            pack = lambda flags: _pack(place - texts.offs[doc], place - left, right - place, multi.astype(np.int64), flags)
            rk = key[doc]
            # repeats within the batch are told at once, under their own row's key; one of each goes on
            rows = [np.concatenate([a[first], b[multi]]) for a, b in ((rk, rk), (anchor.astype(np.int64), rk), (context.astype(np.int64), place), (pack(0 * done), pack(done)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["rk", "a", "c", "p"])

    return run


def common_prefix(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows of two byte matrices with these row lengths."""
    same = x == y
    width = x.shape[1]
    first = np.where(same.all(axis=1), width, same.argmin(axis=1))
    return np.minimum(first, np.minimum(nx, ny))


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in parts])
    width = max(1, int(size.max(initial=0)))
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width), size


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The interval tree of a suffix array by a stack scan: (common length, first, last) of every interval of two or more.

    ``lcp[i]`` is the common prefix of entries i - 1 and i; ``lcp[0]`` is not used.  Children come before parents.
    """
    stack: list[tuple[int, int]] = []  # common length, first entry
    for i in range(1, len(lcp) + 1):
        value, first = (int(lcp[i]) if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


class Contexts:
    """Contexts cut at a common anchor, as a suffix array of the parts from the anchor on with its common prefixes.

    ``before`` are the parts left of the anchor, reversed; ``after`` those from the anchor on.
    """

    def __init__(self, before: list[bytes], after: list[bytes]) -> None:
        order = sorted(range(len(after)), key=after.__getitem__)
        self.order = np.array(order, np.int64)
        tail, tail_n = _matrix([after[i] for i in order])
        self.head, self.head_n = _matrix([before[i] for i in order])
        self.lcp = np.zeros(len(order), np.int64)
        self.lcp[1:] = common_prefix(tail[:-1], tail[1:], tail_n[:-1], tail_n[1:])
        self.rank = np.empty(len(order), np.int64)
        self.rank[sorted(range(len(order)), key=lambda j: before[order[j]])] = np.arange(len(order))

    def left_of(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries of an interval sorted by the bytes before the anchor, and how many of these neighbours share."""
        at = lo + np.argsort(self.rank[lo : hi + 1])
        return at, common_prefix(self.head[at[:-1]], self.head[at[1:]], self.head_n[at[:-1]], self.head_n[at[1:]])


def _best(shared: np.ndarray) -> np.ndarray:
    """For each entry, the most it shares with the one before or after."""
    best = np.zeros(len(shared) + 1, np.int64)
    best[:-1] = shared
    best[1:] = np.maximum(best[1:], shared)
    return best


def repeat_groups(before: list[bytes], after: list[bytes], length: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Repeat groups of ``length`` bytes or more among contexts cut at a common anchor (see :class:`Contexts`).

    Yields the common bytes from the anchor on, all members, and how many bytes before the anchor each shares with
    another member.
    """
    c = Contexts(before, after)
    for depth, lo, hi in intervals(c.lcp):
        at, shared = c.left_of(lo, hi)
        best = _best(shared)
        for run in np.split(np.arange(len(at)), np.flatnonzero(shared + depth < length) + 1):  # left extensions differ here
            if len(run) > 1 and depth > 0:
                yield depth, c.order[at[run]].tolist(), best[run].tolist()


def repeated_ranges(before: list[bytes], after: list[bytes], alone: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the repeat groups cover of the members marked ``alone``: member, bytes before the anchor, bytes from it on.

    Intervals come with falling depth for each member, so a later one adds something only where more is shared on the
    left; intervals whose marked members have nothing left to gain are passed over.
    """
    c = Contexts(before, after)
    wanted = alone[c.order]
    seen = np.where(wanted, -1, c.head_n)
    found = []
    for depth, lo, hi in intervals(c.lcp):
        part = slice(lo, hi + 1)
        if depth == 0 or not ((seen[part] < c.head_n[part]) & (c.head_n[part] + depth >= length)).any():
            continue
        at, shared = c.left_of(lo, hi)
        best = _best(shared)
        new = (best + depth >= length) & (best > seen[at])
        seen[at[new]] = best[new]
        found.append((c.order[at[new]], best[new], np.full(int(new.sum()), depth)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _tree_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            rk, at, alone = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
            member, left, depth = repeated_ranges([r[4] for r in rows], [r[5] for r in rows], alone, length)
            return rk[member], at[member] - left, at[member] + depth

        def out(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["rk", "s", "e"])

        for batch in batches:  # sorted by anchor
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][0] != row[0]:
                    done.append(solve(held))
                    held = []
                held.append(row)
            yield out(done)
        if held:
            yield out([solve(held)])

    return run


def _window_rows(length: int):
    """All windows of contexts: anchor, hash of the window and its place about the anchor, row, start, whether the context is alone."""
    span = length - _gram(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t"):
            rows = [[np.zeros(0, np.int64)] for _ in range(4)] + [[np.zeros(0, bool)]]
            for rk, text, needs in zip(*(batch.column(c).to_pylist() for c in ("rk", "t", "needs")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                spans = B.SpanHash(B.BYTE_CODE[data])
                for x in needs:
                    at = x["p"] >> 24
                    start = np.arange(max(0, at - span + 1), min(at, len(data) - length) + 1)
                    code = spans.of(start, start + length) ^ B.mix((at - start).astype(np.uint64))
                    for column, made in zip(rows, (np.full(len(start), x["a"]), code.astype(np.int64), np.full(len(start), rk), start, np.full(len(start), x["alone"])), strict=True):
                        column.append(made)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in rows], ["a", "h", "rk", "s", "alone"])

    return run


def _contexts(length: int):
    span = length - _gram(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t"):
            rows = []
            for rk, text, needs in zip(*(batch.column(c).to_pylist() for c in ("rk", "t", "needs")), strict=True):
                raw = text.encode()
                for x in needs:
                    at = x["p"] >> 24
                    rows.append((x["a"], rk, at, x["alone"], raw[max(0, at - span + 1) : at][::-1], raw[at : at + length]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["a", "rk", "at", "alone", "before", "after"])

    return run


def row_key(doc_id: str, text: str) -> F.Column:
    return F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 200, crowd: int = 100_000) -> DataFrame:
    """``rk`` (see :func:`row_key`), ``s`` and ``e``: byte ranges that occur again, of ``length`` bytes or more.

    The ranges of a row may overlap; together they cover exactly the bytes inside a repeated window.  Anchors with more
    than ``crowd`` different contexts do not meet in one task: their windows are counted by hash instead.
    """
    if not 2 <= length <= 1000:
        raise ValueError("length from 2 to 1000 bytes")
    rows = docs.select(row_key(doc_id, text).alias("rk"), F.col(text).alias("t")).where(F.octet_length("t") >= length)
    told = rows.mapInArrow(_anchor_rows(length), "rk long, a long, c long, p long").withColumn("done", F.col("p").bitwiseAND(F.lit(1)))
    one, ordered = W.partitionBy("done", "a"), W.partitionBy("done", "a").orderBy("c")
    flag = lambda c: F.coalesce(c, F.lit(False))
    marked = told.withColumns({"last": F.lag("c").over(ordered), "next": F.lead("c").over(ordered)})
    marked = marked.withColumns({"again": (F.col("p").bitwiseAND(F.lit(3)) > 0) | flag(F.col("last") == F.col("c")) | flag(F.col("next") == F.col("c")), "first": ~flag(F.col("last") == F.col("c"))})
    marked = marked.withColumns({"several": F.min("c").over(one) != F.max("c").over(one), "some_alone": F.max(~F.col("again")).over(one), "contexts": F.sum(F.col("first").cast("long")).over(one)})
    need = (F.col("done") == 0) & F.col("first") & F.col("several") & F.col("some_alone")
    kept = cut(marked.select("rk", "a", "p", "again", need.alias("need"), (need & (F.col("contexts") > crowd)).alias("crowded")).where("again or need"))

    at = F.shiftright("p", 24)
    part = lambda by, bits: F.shiftright("p", by).bitwiseAND(F.lit(bits))
    whole = kept.where("again").select("rk", (at - part(14, 1023)).alias("s"), (at + part(2, 4095)).alias("e"))
    needs = lambda which: kept.where(which).groupBy("rk").agg(F.collect_list(F.struct("a", "p", (~F.col("again")).alias("alone"))).alias("needs")).hint("shuffle_hash")
    contexts = rows.join(needs("need and not crowded"), "rk").mapInArrow(_contexts(length), "a long, rk long, at long, alone boolean, before binary, after binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = contexts.repartition(partitions, "a").sortWithinPartitions("a").mapInArrow(_tree_rows(length), "rk long, s long, e long")
    found = whole.unionByName(tree)
    if kept.where("crowded").isEmpty():
        return found
    windows = rows.join(needs("crowded"), "rk").mapInArrow(_window_rows(length), "a long, h long, rk long, s long, alone boolean")
    often = windows.groupBy("a", "h").agg(F.count("*").alias("n")).where("n > 1").select("a", "h")
    counted = windows.where("alone").join(often, ["a", "h"], "left_semi").select("rk", "s", (F.col("s") + length).alias("e"))
    return found.unionByName(counted)


def strip_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 200, crowd: int = 100_000) -> DataFrame:
    """``docs`` with ``kept`` (binary, the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed runs).

    A byte goes if a ``length``-byte string over it starts anywhere else too, in the same text or another; repeats are
    judged on the texts as they come in.  Null texts are empty; repeated rows count as occurrences of each other;
    texts shorter than ``length`` stay; what is left may cut through a character, hence binary.
    """
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    base = docs.drop(*made)
    key, of, held = fresh(base, "key", "of", "spans")
    # a set, since repeated rows share a key and each of them brings the same ranges
    found = cut(repeats(docs, doc_id=doc_id, text=text, length=length, crowd=crowd))
    spans = found.groupBy(F.col("rk").alias(of)).agg(F.collect_set(F.struct("s", "e")).alias(held))
    keyed = base.withColumn(key, row_key(doc_id, text))
    joined = keyed.join(spans.hint("shuffle_hash"), F.col(key) == F.col(of), "left").select(*own(base), held)
    names = base.columns
    schema = base.select("*", F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in made[1:]]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, text):
            kept, counts = [], []
            for t, ranges in zip(batch.column(text).to_pylist(), batch.column(held).to_pylist(), strict=True):
                raw = (t or "").encode()
                left, upto, runs = [], 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in ranges or ()):
                    if s > upto or not runs:
                        left.append(raw[upto:s])
                        runs += 1
                    upto = max(upto, e)
                left.append(raw[upto:])
                kept.append(b"".join(left))
                counts.append((len(raw), len(raw) - len(kept[-1]), runs))
            mine = [batch.column(c) for c in names]
            numbers = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([*mine, pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in numbers]], [*names, *made])

    return joined.mapInArrow(run, schema)
