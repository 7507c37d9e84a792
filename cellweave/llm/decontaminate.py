"""Benchmark decontamination with suffix arrays of the training texts.

Each shard (a bounded batch of documents) becomes a word sequence with a
separator after every text, and gets a suffix array by prefix doubling, ordered as
deep as a window is long, which is all that the search looks at.  The windows of
the benchmark items whose words the shard has are then binary-searched, some ten
thousands at once; the range a window gets in the array is the list of all its
occurrences.  The array serves its shard and block and is not kept.  Occurrences on
one diagonal that follow each other join into the longest verbatim matches.

Documents are never shuffled and there is no state across shards, so a lost
executor costs its own partitions.  The benchmark is read to the driver in
blocks of at most ``block_words`` words and each block is broadcast for one pass
over the documents, whose spans and items the passes gather in two columns.  The
passes of several blocks run as one chain, with a Python worker for each block in
every task that runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytespans as B

SLICE = 1 << 15  # windows searched at once
SHARD = 2 << 20  # bytes of text in a suffix array, whose sorting holds some dozens of 8-byte arrays of its words
FOUND = "array<struct<s:long,e:long>>"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a column of texts, and each text's offsets."""
    texts = B.Texts(column)
    low = B.LOWER[texts.data]
    starts, ends, at = texts.runs(B.ALNUM[low])
    return B.SpanHash(B.BYTE_CODE[low]).of(starts, ends), at


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``seq`` (integers, 0 lowest) ordered by their first ``depth`` items."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    rank = np.zeros(n, np.int64)
    slot = np.arange(n)

    def ranked(slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Give the suffixes in these slots, sorted by key, the first slot of equal keys; which are still tied."""
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[sa[slots]] = np.maximum.accumulate(np.where(new, slots, -1))
        tied = ~new
        tied[:-1] |= ~new[1:]
        return slots[tied]

    open_slots = ranked(slot, seq[sa])
    k = 1
    while k < depth and len(open_slots):
        at = sa[open_slots]
        ahead = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 2) + ahead
        order = np.argsort(key, kind="stable")
        sa[open_slots] = at[order]
        open_slots = ranked(open_slots, key[order])
        k *= 2
    return sa


def search(seq: np.ndarray, sa: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (a row of ids, padded), the range of the array whose suffixes start with it."""
    n, out = len(sa), []
    for upper in (False, True):
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), n, np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            at, sign, todo = sa[mid], np.zeros(len(live), np.int8), np.arange(len(live))
            for j in range(windows.shape[1]):
                todo = todo[(sign[todo] == 0) & (j < lengths[live[todo]])]
                if not todo.size:
                    break
                place = at[todo] + j
                have = np.where(place < n, seq[np.minimum(place, n - 1)], -1)
                sign[todo] = np.sign(have - windows[live[todo], j])
            right = (sign < 0) | ((sign == 0) & upper)
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


class Items:
    """One block of benchmark items as word hashes, cut into windows."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int) -> None:
        self.ids, self.window = ids, window
        self.words, at = words_of(pa.array(texts, pa.string()))
        count = np.diff(at)
        self.longest = int(count.max(initial=0))
        n_windows = np.where(count == 0, 0, np.maximum(1, count - window + 1))
        self.item = np.repeat(np.arange(len(ids), dtype=np.int32), n_windows)
        self.start = (np.arange(len(self.item)) + np.repeat(at[:-1] - (np.cumsum(n_windows) - n_windows), n_windows)).astype(np.int32)
        self.length = np.minimum(window, count[self.item]).astype(np.int32)

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal verbatim matches of a window's length or more: first word (over the shard), words, item."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.item) or not len(words):
            return none
        vocabulary, ids = np.unique(words, return_inverse=True)
        where = np.minimum(np.searchsorted(vocabulary, self.words), len(vocabulary) - 1)
        test = np.where(vocabulary[where] == self.words, where + 1, -1)
        unknown = np.concatenate([[0], np.cumsum(test < 0)])
        live = np.flatnonzero(unknown[self.start + self.length] == unknown[self.start])  # all words known here
        if not live.size:
            return none
        gap = np.zeros(len(words) + 1, np.int64)
        np.add.at(gap, at[1:-1], 1)  # separators before each word
        shift = np.cumsum(gap[:-1])
        seq = np.zeros(len(words) + len(at) - 1, np.int64)
        place = np.arange(len(words)) + shift
        seq[place] = ids + 1
        word_at = np.zeros(len(seq), np.int64)
        word_at[place] = np.arange(len(words))
        sa = suffix_array(seq, max(self.window, int(self.length.max())))
        ranges = []
        for k in range(0, len(live), SLICE):
            part = live[k : k + SLICE]
            steps = np.arange(int(self.length[part].max()))
            inside = steps < self.length[part, None]
            rows = np.where(inside, test[np.minimum(self.start[part, None] + steps, len(test) - 1)], 0)
            ranges.append(search(seq, sa, rows, self.length[part]))
        lo, hi = (np.concatenate(x) for x in zip(*ranges, strict=True))
        found = hi - lo
        which = np.repeat(live, found)
        slots = np.repeat(lo, found) + (np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found))
        first = word_at[sa[slots]]
        diagonal = first - self.start[which]
        order = np.lexsort((self.start[which], diagonal, self.item[which]))
        which, first, diagonal = which[order], first[order], diagonal[order]
        if not len(which):
            return none
        new = np.ones(len(which), bool)
        new[1:] = (self.item[which][1:] != self.item[which][:-1]) | (diagonal[1:] != diagonal[:-1]) | (self.start[which][1:] != self.start[which][:-1] + 1) | (np.searchsorted(at, first[1:], "right") != np.searchsorted(at, first[:-1], "right"))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(which)) - 1
        return first[head], first[tail] + self.length[which[tail]] - first[head], self.item[which[head]]


def _blocks(benchmark: DataFrame, id_col: str, text: str, block_words: int) -> Iterator[tuple[list[str], list[str | None]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    sized = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"), F.octet_length(text).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-int(total) // (block_words * 6)))
    for k in range(n_blocks):
        part = sized if n_blocks == 1 else sized.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == k)
        rows = part.select("i", "t").collect()
        yield [r.i for r in rows], [r.t for r in rows]


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 4_000_000) -> DataFrame:
    """``docs`` with ``bm_words`` (words of the text), ``bm_hit`` (words inside any occurrence of a window),
    ``bm_items`` (ids of items that occur), ``bm_longest`` (words of the longest verbatim match) and
    ``bm_spans`` (word ranges of the matches).

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer.  Null and empty
    texts have no words and no hits; empty items and an empty benchmark match nothing; repeated rows are
    each judged; columns of ``docs`` stay, and those five names replace columns of the same name.
    """
    made = ["bm_words", "bm_hit", "bm_items", "bm_longest", "bm_spans"]
    out = docs.drop(*made)
    schema = T.StructType([*out.schema.fields, *T._parse_datatype_string(f"bm_words long, bm_spans {FOUND}, bm_items array<string>").fields])
    out = out.select("*", F.lit(0).cast("long").alias("bm_words"), F.array().cast(FOUND).alias("bm_spans"), F.array().cast("array<string>").alias("bm_items"))
    spark = docs.sparkSession
    for ids, texts in _blocks(benchmark, item_id, item_text, block_words):
        sent = spark.sparkContext.broadcast((ids, texts, window))
        out = out.mapInArrow(_matcher(sent, text, schema.names), schema)
    length = lambda x: x["e"] - x["s"]
    merged = F.aggregate(  # the spans of each block are sorted and disjoint; several blocks may overlap
        F.array_sort("bm_spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.struct((a["hit"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["upto"]))).alias("hit"), F.greatest(a["upto"], x["e"]).alias("upto")),
    )
    return out.withColumns({"bm_hit": merged["hit"], "bm_longest": F.coalesce(F.array_max(F.transform("bm_spans", length)), F.lit(0).cast("long")), "bm_items": F.array_sort(F.array_distinct("bm_items"))})


def _matcher(sent, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*sent.value)
        for batch in B.chunked(batches, text, SHARD):
            words, at = words_of(batch.column(text))
            first, count, item = items.hits(words, at)
            doc = np.searchsorted(at, first, "right") - 1
            table = pd.DataFrame({"doc": doc, "s": first - at[doc], "e": first - at[doc] + count, "item": item}).drop_duplicates()
            spans, found = batch.column("bm_spans").to_pylist(), batch.column("bm_items").to_pylist()
            for d, part in table.groupby("doc"):
                spans[d] = spans[d] + [{"s": int(s), "e": int(e)} for s, e in sorted(set(zip(part.s, part.e, strict=True)))]
                found[d] = found[d] + sorted({items.ids[i] for i in part.item})
            made = {"bm_words": pa.array(np.diff(at), pa.int64()), "bm_spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), "bm_items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n) if n in batch.schema.names else None) for n in names], names)

    return run


def contaminated() -> F.Column:
    """The rule: some word is hit, and hits are a twentieth of the words or more."""
    return (F.col("bm_hit") > 0) & (20 * F.col("bm_hit") >= F.col("bm_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Documents that are not contaminated, with their own columns (see :func:`match_benchmark`)."""
    return match_benchmark(docs, benchmark, **how).where(~contaminated()).select(*[F.col(f"`{c}`") for c in docs.columns])
