"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made per text in tasks.  Everything after that works on the
*distinct* fingerprints, so copies of a text never meet in pairs.

Linking: the 64 bits are cut into partitions that keep correlated bits
together.  If thresholds t_i (-1 leaves a partition out) sum to
``distance - partitions + 1``, two fingerprints within ``distance`` agree to
within t_i in at least one partition.  A dynamic program gives each partition
its threshold so that the estimated number of candidates is least.  A
fingerprint is stored under its own value in each partition and probes all
values within the threshold; candidates are verified on all 64 bits.

A bucket that holds more than ``bucket`` distinct fingerprints is never paired
up.  Its members agree on the bucket's bits, so the pigeonhole holds again for
the bits that are left, and they are dealt into finer buckets by these.  What is
crowded still after some levels goes another exact way: each such fingerprint is
put under itself and its neighbours at distance 1.  Two of them share such a
midpoint exactly if they differ in two bits or fewer, so linking each member of
a midpoint to its smallest one gives the same components from 65 rows a
fingerprint, and no pairs.

Near copies (:func:`near_copies`, the rule of near-duplicate stages) are texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more.  What :func:`near_duplicates` puts into one component is held against this rule first.
Similar texts can lie farther apart than its 2 bits, so a search by prefixes follows for pairs of what is not linked yet,
which loses no pair: a similar text shares at least 0.8 of
either set, so in any order of the shingles the two meet in one among the first fifth of each.  Shingles are ordered
from rare to common, those that no other text has first; a text that has more than a fifth of these drops out
beforehand (:func:`_alive`).  Where two texts meet, what is left of both from there on bounds what they share; the rest are
verified on the two whole sets.  Pairs within a large group are not formed: members of a crowded bucket are
first held against a few pivots, and the search then looks for pairs of different components only, a large component
never being held against itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytespans as B
from .clusterio import cut, fresh, own, sent_if_few

BITS = 64
SEED = 42
_PLACE = B.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_ODD = B.mix(np.arange(1001, 1001 + 256, dtype=np.uint64))
SLICE = 0.35  # of the values of shingle hashes, where texts are searched for shingles of their own
FLUSH = 1 << 19  # shingles that a task holds before it deals them out
PER_RANGE = 500_000  # shingles in a range of hashes
PER_TASK = 200_000  # light rows that a task writes


def _tasks(rows: int) -> int:
    """Tasks that write so many light rows; many small files are not light."""
    return max(4, -(-rows // PER_TASK))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as a signed 64-bit integer; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        pieces = [b" ".join(words)]
    else:
        pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    codes = np.frombuffer(b"".join([digest(x, SEED) for x in pieces]), np.uint8).reshape(-1, 8)
    votes = np.unpackbits(codes, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(codes)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (signed 64-bit SimHash) of every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t"):
            codes = [fingerprint(t, shingle) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes, pa.int64())], ["doc_id", "fp"])

    light = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    return light.mapInArrow(run, light.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 matrix of how often two bits are both set, over all of ``prints``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 1 << 16):
                bits = np.unpackbits(fp[k : k + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(fp)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[i, j], n))], ["i", "j", "n"])

    both, n = np.zeros((BITS, BITS)), 0
    for r in prints.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # at most 2,081 rows
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Cut the bits into equal partitions, each grown from a seed by the bits most correlated with it."""
    mean = both.diagonal() / max(n, 1)
    dev = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(dev, dev))
    free, out = list(range(BITS)), []
    for k in range(partitions, 0, -1):
        size = -(-len(free) // k)
        group = [max(free, key=lambda b: (corr[b][free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b][group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of -1 and up, one for each partition, that sum to ``total`` at the least cost.

    ``costs[i][t + 1]`` is the cost of threshold t in partition i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (spent, (cost, path)), (t, c) in itertools.product(best.items(), enumerate(row, start=-1)):
            if spent + t not in step or cost + c < step[spent + t][0]:
                step[spent + t] = (cost + c, [*path, t])
        best = step
    return best[total][1]


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    return int(np.uint64(sum(1 << b for b in bits)).astype(np.int64))


def plan(prints: DataFrame, distance: int = 2, *, row_cost: float = 1.0) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of every partition to probe, of the cheapest cut into a few partitions, ``distance + 2`` at most.

    Pairs that agree in a whole partition are counted over all fingerprints; those that differ in some of its
    bits follow from the bits' own frequencies.  A probe also costs ``row_cost`` candidates for each value it looks up.
    """
    n, both = bit_statistics(prints)
    mean = both.diagonal() / max(n, 1)
    differ = 2 * mean * (1 - mean)
    odds = differ / np.maximum(1 - differ, 1e-3)
    cuts = [group_bits(n, both, m) for m in range(max(2, distance // 3 + 1), min(distance + 2, max(4, distance // 2 + 2)) + 1)]
    masks = [[mask_of(g) for g in groups] for groups in cuts]
    keys = [F.struct(F.lit(f"{m}/{i}").alias("p"), F.col("fp").bitwiseAND(F.lit(x)).alias("key")) for m, row in enumerate(masks) for i, x in enumerate(row)]
    sizes = prints.select(F.explode(F.array(*keys)).alias("k")).groupBy("k").count()
    pairs = {r.p: float(r.pairs or 0) for r in sizes.groupBy("k.p").agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).collect()}  # a row for each partition
    best = None
    for m, groups in enumerate(cuts):
        costs = []
        for i, group in enumerate(groups):
            row, same, up, looked = [0.0], pairs.get(f"{m}/{i}", 0.0), [1.0], 1.0
            for t in range(distance + 1):
                row.append(same * sum(up) + max(n, 1) * looked * row_cost)
                up.append(up[-1] * odds[group].sum() / (t + 1))
                looked += reduce(lambda a, j: a * (len(group) - j) / (j + 1), range(t + 1), 1.0)
            costs.append(row)
        t = allocate(costs, distance - len(groups) + 1)
        cost = sum(row[x + 1] for row, x in zip(costs, t, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(x, g, y) for x, g, y in zip(masks[m], groups, t, strict=True) if y >= 0])
    return best[1]


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [g for g in (bits[k::parts] for k in range(parts)) if g]


def links(prints: DataFrame, *, distance: int = 2, bucket: int = 64, levels: int = 3, few: int | None = None) -> DataFrame:
    """``u`` > ``v``: links that join exactly the fingerprints (distinct, column ``fp``) that lie within
    ``distance`` (at most 2) bits of each other, directly or through others.  ``few`` bounds the tasks that write steps."""
    if not 0 <= distance <= 2:
        raise ValueError("midpoints join fingerprints at 2 or fewer bits")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    parts = [(F.lit(p), mask, bits, threshold) for p, (mask, bits, threshold) in enumerate(plan(prints, distance))]
    key = lambda mask: F.col("fp").bitwiseAND(F.lit(mask))
    flips = lambda bits, t: [mask_of(list(c)) for k in range(t + 1) for c in itertools.combinations(bits, k)]
    put = lambda columns: prints.select("fp", F.explode(F.array(*columns)).alias("k")).select("fp", "k.p", "k.key")
    stored = put([F.struct(p.alias("p"), key(m).alias("key")) for p, m, _, _ in parts])
    plain = all(t == 0 for *_, t in parts)
    probes = stored if plain else put([F.struct(p.alias("p"), key(m).bitwiseXOR(F.lit(x)).alias("key")) for p, m, bits, t in parts for x in flips(bits, t)])
    masks = {p: bits for p, (_, _, bits, _) in enumerate(parts)}
    found, hot, light = [], None, (lambda df: df.coalesce(few)) if few else (lambda df: df)
    for level in range(levels):
        crowded = sent_if_few(cut(light(stored.groupBy("p", "key").count().where(F.col("count") > bucket).select("p", "key"))))
        calm = stored.join(crowded, ["p", "key"], "left_anti")
        pairs = (calm if plain else probes.join(crowded, ["p", "key"], "left_anti")).withColumnRenamed("fp", "u").join(calm.withColumnRenamed("fp", "v"), ["p", "key"]).where((F.col("u") > F.col("v") if plain else F.col("u") != F.col("v")) & near)
        found.append(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        if crowded.isEmpty():
            break
        inside = probes if plain else stored.unionByName(probes)
        hot = cut(light(inside.join(crowded, ["p", "key"], "left_semi")))
        if not plain or level == levels - 1:
            break
        # members of a crowded bucket agree on its bits, so they differ within the rest: cut that into partitions again
        children, below = None, {}
        for p, bits in masks.items():
            made = []
            for part in _split([b for b in range(BITS) if b not in bits], distance + 1):
                below[len(below)] = sorted([*bits, *part])
                made.append(F.struct(F.lit(len(below) - 1).alias("p"), key(mask_of(below[len(below) - 1])).alias("key")))
            children = F.when(F.col("p") == p, F.array(*made)) if children is None else children.when(F.col("p") == p, F.array(*made))
        stored = probes = hot.select("fp", F.explode(children).alias("k")).select("fp", "k.p", "k.key")
        masks, hot = below, None
    if hot is not None:
        found.append(_stars(hot.select("fp").distinct(), distance))
    return reduce(DataFrame.unionByName, found).distinct()


def _stars(hot: DataFrame, distance: int) -> DataFrame:
    """Links by way of midpoints: 65 rows for each fingerprint, whatever their number in one place."""
    flip = lambda b: F.col("fp").bitwiseXOR(F.lit(mask_of([b])))
    mids = [F.col("fp")]
    if distance == 2:
        mids += [flip(b) for b in range(BITS)]
    elif distance == 1:  # two neighbours meet in the lower of them
        mids += [F.least("fp", flip(b)) for b in range(BITS)]
    at = hot.select("fp", F.explode(F.array(*mids)).alias("mid"))
    least = at.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where(F.col("v") < F.col("top")).select("mid", "v")
    return at.join(least, "mid").where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v")


def components(edges: DataFrame, *, rounds: int = 60, per_task: int = 200_000) -> DataFrame:
    """``node`` and ``root`` (least node of its component) of every node that has a link; columns ``u`` > ``v``.

    Alternating large-star and small-star steps; the links are written after each round, so lineage stays
    short, and the rounds end when a pass changes nothing.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges, seen = cut(edges), None
    few = max(4, -(-edges.count() // per_task))  # tasks of a round: links are light, and many small shuffle files are not
    for _ in range(rounds):
        edges = edges.coalesce(few)
        if (now := mark(edges)) == seen or not now[0]:
            break
        seen = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").coalesce(few).distinct().coalesce(few)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u > v").coalesce(few).distinct().coalesce(few))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", made: str | None = None, few: int | None = None, shingle: int = 3, distance: int = 2, bucket: int = 64) -> DataFrame:
    """``doc_id``, ``fp``, ``root`` (the component's least fingerprint) and ``component_id`` (least doc_id reachable over links, its own included) of every row.

    Null and blank texts have fingerprint 0, which links like any other.  Rows whose doc_id is null keep null as
    doc_id and take part; a component of such rows alone has a null component_id.  Repeated rows give repeated
    rows; an empty table gives none.  ``made`` names a column of fingerprints where there is one, of rows that are
    written already, so that texts are not read again.  ``few`` bounds the tasks that write steps.
    """
    if made:
        prints = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{made}`").alias("fp"))
    else:
        prints = cut(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = cut(classes.coalesce(few) if few else classes)
    joined = components(links(classes.select("fp"), distance=distance, bucket=bucket, few=few))
    rooted = classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "root", "component_id")


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's runs of ``size`` words (one of all words if they are fewer), and offsets by text."""
    texts = B.Texts(column)
    low = B.LOWER[texts.data]
    starts, ends, at = texts.runs(B.NOT_BLANK[low])
    words = B.SpanHash(B.BYTE_CODE[low]).of(starts, ends)
    doc = B.owner(at)
    here = np.arange(len(words))
    left = at[doc + 1] - here  # words from here to the end of the text
    first = np.flatnonzero((left >= size) | (here == at[doc]))
    total = np.zeros(len(first), np.uint64)
    for j in range(size):
        go = left[first] > j
        total[go] = B.mix(total[go] + words[first[go] + j] * _PLACE[j])
    _, later = B.repeated(doc[first], total)
    return total[~later], np.searchsorted(doc[first][~later], np.arange(texts.n + 1))


def set_codes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A signed 64-bit code of each set of hashes, whatever their order; 0 for an empty set."""
    n = np.diff(at)
    out, full = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(full):
        out[full] = B.mix(np.add.reduceat(B.mix(hashes ^ _ODD[0]), at[:-1][full]) + n[full].astype(np.uint64))
    return out.view(np.int64)


def signatures(hashes: np.ndarray, at: np.ndarray, longs: int = 4) -> list[np.ndarray]:
    """One-bit min-hashes of each set as ``longs`` signed 64-bit integers: two sets differ in a bit with a chance of (1 - Jaccard) / 2; 0 for an empty set."""
    full = np.flatnonzero(np.diff(at))
    out = [np.zeros(len(at) - 1, np.uint64) for _ in range(longs)]
    if len(full):
        starts = at[:-1][full]
        for k in range(64 * longs):
            least = np.minimum.reduceat((hashes ^ (hashes >> np.uint64(29))) * (_ODD[k] | np.uint64(1)), starts)
            out[k // 64][full] |= ((least >> np.uint64(17)) & np.uint64(1)) << np.uint64(k % 64)
    return [x.view(np.int64) for x in out]


def text_key(text: F.Column) -> F.Column:
    """128 bits that stand for a text; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _marked(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``id``, ``key`` (see :func:`text_key`), fingerprint ``fp``, and ``code`` and size ``n`` of the set of ``words``-word shingles, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t", B.LESS):
            hashes, at = shingles(batch.column("t"), words)
            prints = pa.array([fingerprint(t) for t in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), prints, pa.array(set_codes(hashes, at)), pa.array(np.diff(at))], ["id", "key", "fp", "code", "n"])

    light = docs.select(F.col(f"`{doc_id}`").alias("id"), text_key(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("t"))
    return light.mapInArrow(run, light.select("id", "key", *[F.lit(0).cast("long").alias(c) for c in ("fp", "code", "n")]).schema)


def _texts(docs: DataFrame, sets: DataFrame, codes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``code`` and a text ``t`` of the sets named in ``codes``; rows that repeat id and text repeat."""
    few = _tasks(codes.count())
    wanted = sent_if_few(cut(sets.join(codes, "code", "left_semi").select("code", F.col("by.key").alias("want"), F.col("by.least").alias("named")).coalesce(few)))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), text_key(F.col(f"`{text}`")).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return texts.join(wanted, (F.col("key") == F.col("want")) & F.col("id").eqNullSafe(F.col("named"))).select("code", "t")


def _gathered(batches: Iterator[pa.RecordBatch], words: int, most: float = 1.0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shingles of many texts at once whose hashes are in the lowest ``most`` of all values, with the codes and sizes of their texts' sets."""
    held, size = [], 0
    for batch in B.chunked(batches, "t", B.LESS):
        hashes, at = shingles(batch.column("t"), words)
        n = np.diff(at)
        code, n, low = np.repeat(set_codes(hashes, at), n), np.repeat(n, n), (hashes >> np.uint64(32)) < np.uint64(most * 2**32)
        held.append((hashes[low], code[low], n[low]))
        size += len(held[-1][0])
        if size >= FLUSH:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _range(high: np.ndarray, ranges: int, most: float = 1.0) -> np.ndarray:
    """The range of each 32-bit value, of so many in the lowest ``most`` of all values."""
    return np.minimum(high.astype(np.uint64) * np.uint64(ranges) // np.uint64(most * 2**32), np.uint64(ranges - 1)).astype(np.int64)


def _blocks(to: np.ndarray, ranges: int, **columns: np.ndarray) -> pa.Table:
    """A row for each range ``to`` that occurs, with its part of each column as bytes."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(ranges + 1))
    full = np.flatnonzero(np.diff(ends))
    return pa.table({"to": pa.array(full, pa.int64()), **{c: pa.array([y[ends[r] : ends[r + 1]].tobytes() for r in full], pa.binary()) for c, y in ((c, x[order]) for c, x in columns.items())}})


def _read(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds.items()]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _alive(docs: DataFrame, sets: DataFrame, total: int, *, text: str, words: int, similarity: float) -> DataFrame:
    """``code`` and ``n`` of the sets that may be similar to another: of what they hold, enough may be in others too.

    Shingles that one set alone has are counted where their hashes are in the lowest ``SLICE`` of all values; more of them
    than dissimilar shingles are allowed rule a set out, whatever the others are.  Hashes and codes are shortened to 32 bits:
    shingles taken for one another count as shared, and sets whose codes are taken for one another are judged by all of their
    shingles, so neither loses a pair unless just these two have a shingle.  A shingle comes at most twice from a batch, however many texts have it.
    """
    ranges = max(4, round(total * SLICE / PER_RANGE))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, code, _ in _gathered(batches, words, SLICE):
            order = np.argsort(hashes, kind="stable")
            hashes, code = hashes[order], (code[order] & 0xFFFFFFFF).astype(np.uint32)
            first = _starts(hashes)
            low, high = np.minimum.reduceat(code, first), np.maximum.reduceat(code, first)
            two = low != high
            hashes, code = np.concatenate([hashes[first], hashes[first][two]]), np.concatenate([low, high[two]])
            yield from _blocks(_range(hashes >> np.uint64(32), ranges, SLICE), ranges, hash=hashes.astype(np.uint32), code=code).to_batches()

    def alone(table: pa.Table) -> pa.Table:
        hashes, code = _read(table, hash=np.uint32, code=np.uint32)
        order = np.argsort(hashes, kind="stable")
        first = _starts(hashes[order])
        low, high = (f.reduceat(code[order], first) for f in (np.minimum, np.maximum))
        code, count = np.unique(low[low == high], return_counts=True)
        return _blocks(_range(code, ranges), ranges, code=code, count=count.astype(np.uint32))

    def added(table: pa.Table) -> pa.Table:
        code, count = _read(table, code=np.uint32, count=np.uint32)
        order = np.argsort(code, kind="stable")
        first = _starts(code[order])
        return pa.table({"low": pa.array(code[order][first].astype(np.int64)), "alone": pa.array(np.add.reduceat(count[order].astype(np.int64), first))})

    sent = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).mapInArrow(dealt, "to long, hash binary, code binary")
    parts = sent.groupBy("to").applyInArrow(alone, "to long, code binary, count binary")
    counts = parts.groupBy("to").applyInArrow(added, "low long, alone long")
    named = sets.where("n > 0").select("code", "n", F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low")).join(counts, "low", "left")
    same = Window.partitionBy("low")
    left = F.sum("n").over(same) - F.coalesce("alone", F.lit(0))
    return named.withColumn("ok", left >= similarity * F.min("n").over(same) - 1e-9).where("ok").select("code", "n")


def _postings(docs: DataFrame, sets: DataFrame, alive: DataFrame, *, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """``token``, ``code``, ``n`` and ``rest``: the prefixes of the sets in ``alive``, from the rarest shingle that two of them have to where fewer than ``similarity`` of a set are left.

    ``rest`` is how many shingles are left, this one among them, that another of these sets has too.
    """
    total = alive.agg(F.sum("n")).first()[0] or 0
    ranges = max(4, 2 * round(total / PER_RANGE))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, code, n in _gathered(batches, words):
            yield from _blocks(_range(hashes >> np.uint64(32), ranges), ranges, hash=hashes.astype(np.uint32), code=code, n=n.astype(np.uint32)).to_batches()

    def shared(table: pa.Table) -> pa.Table:
        hashes, code, n = _read(table, hash=np.uint32, code=np.int64, n=np.uint32)
        order = np.lexsort((code, hashes))
        order = order[_starts(hashes[order], code[order])]  # repeated rows give the same shingles again
        hashes, code, n = hashes[order], code[order], n[order]
        first = _starts(hashes)
        often = np.diff(np.append(first, len(hashes)))
        often = np.repeat(often, often)
        two = often > 1
        token = (np.int64(table.column("to")[0].as_py()) << 32) | hashes[two].astype(np.int64)
        to = _range(code[two].view(np.uint64) >> np.uint64(32), ranges)
        return _blocks(to, ranges, token=token, code=code[two], n=n[two], often=often[two].astype(np.uint32))

    def prefixes(table: pa.Table) -> pa.Table:
        token, code, n, often = _read(table, token=np.int64, code=np.int64, n=np.uint32, often=np.uint32)
        order = np.lexsort((token, often, code))
        token, code, n = token[order], code[order], n[order].astype(np.int64)
        first = _starts(code)
        ends = np.append(first[1:], len(code))
        rest = np.repeat(ends, ends - first) - np.arange(len(code))
        keep = rest >= similarity * n - 1e-9
        return pa.table({c: pa.array(x[keep]) for c, x in (("token", token), ("code", code), ("n", n), ("rest", rest))})

    sent = _texts(docs, sets, alive, doc_id, text).select("t").mapInArrow(dealt, "to long, hash binary, code binary, n binary")
    tokens = sent.groupBy("to").applyInArrow(shared, "to long, token binary, code binary, n binary, often binary")
    return tokens.groupBy("to").applyInArrow(prefixes, "token long, code long, n long, rest long")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, *, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """The pairs ``u``, ``v`` of codes whose sets reach the Jaccard similarity.

    Sets are of 32-bit hashes: of n shingles one is taken for another of the other set with a chance of n / 2^32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.chunked(batches, "t", B.LESS):
            hashes, at = shingles(batch.column("t"), words)
            sets = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("code"), sets], ["code", "set"])

    taking_part = cut(pairs.select(F.explode(F.array("u", "v")).alias("code")).distinct().coalesce(_tasks(2 * pairs.count())))
    held = cut(_texts(docs, sets, taking_part, doc_id, text).mapInArrow(run, "code long, set array<int>").dropDuplicates(["code"]))  # repeated rows give the same sets again
    one, two = (held.select(F.col("code").alias(x), F.array_distinct("set").alias(f"set_{x}")) for x in "uv")
    both = pairs.join(two, "v").join(one, "u")
    shared, size = F.size(F.array_intersect("set_u", "set_v")), F.size("set_u") + F.size("set_v")
    return both.where((1 + similarity) * shared >= similarity * size - 1e-9).select("u", "v")


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c != "token"])


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("code_u", "code_v").alias("u"), F.least("code_u", "code_v").alias("v"))


def _enough(similarity: float) -> F.Column:
    """Whether two sets that first meet in a shingle can share enough from there on."""
    return (1 + similarity) * F.least("rest_u", "rest_v") >= similarity * (F.col("n_u") + F.col("n_v")) - 1e-9


def _pivot_pairs(postings: DataFrame, enough: F.Column, bucket: int, pivots: int) -> DataFrame | None:
    """Pairs of the members of each crowded bucket with a few of them, the one with the fewest shingles of its own among them; None if no bucket is crowded."""
    member = lambda *first: F.struct(*first, "code", "n", "rest")
    drawn = [F.max(member((F.col("rest") / F.col("n")).alias("x"))), *(F.min(member(F.xxhash64("code", F.lit(j)).cast("double").alias("x"))) for j in range(1, pivots))]
    crowded = postings.groupBy("token").agg(F.count("*").alias("c"), F.array(*drawn).alias("pivot")).where(F.col("c") > bucket)
    crowded = cut(crowded.select("token", F.explode("pivot").alias("v")).select("token", "v.code", "v.n", "v.rest").distinct())
    if crowded.isEmpty():
        return None
    return _ordered(_sided(postings, "u").join(sent_if_few(_sided(crowded, "v")), "token").where((F.col("code_u") != F.col("code_v")) & enough)).distinct()


def _pairs(nodes: DataFrame, enough: F.Column) -> DataFrame:
    """All pairs of different components that meet in a bucket and can be similar, each once.

    Sets outside of large components are held against all of their buckets; a member of a large one just against the other
    large ones that a bucket holds, so no large component is held against itself.
    """
    small = nodes.where("big is null")
    above = F.col("big_v").isNotNull() | (F.col("code_u") > F.col("code_v"))
    found = _ordered(_sided(small, "u").join(_sided(nodes, "v"), "token").where((F.col("root_u") != F.col("root_v")) & above & enough))
    held = nodes.where("big is not null")
    if held.select("big").distinct().limit(2).count() == 2:
        groups = held.select("token", F.col("big").alias("other")).distinct()
        facing = _sided(held, "u").join(groups, "token").where(F.col("big_u") > F.col("other"))
        found = found.unionByName(_ordered(facing.join(_sided(held, "v").withColumnRenamed("big_v", "other"), ["token", "other"]).where(enough)))
    return found.distinct()


def _print_pairs(classes: DataFrame, few: int) -> DataFrame:
    """Pairs ``u``, ``v`` of codes of sets by the components of :func:`near_duplicates`: each set with one of its fingerprint, one of each fingerprint with one of its component."""
    prints = cut(classes.where("n > 0").select("code", "fp").distinct().coalesce(few))
    at = near_duplicates(prints, doc_id="code", made="fp", few=few).select(F.col("doc_id").alias("code_u"), "fp", F.col("component_id").alias("head"))
    at = cut(at.coalesce(few))
    leads = at.groupBy("fp").agg(F.min("code_u").alias("code_v"), F.first("head").alias("head"))
    alike = at.select("code_u", "fp").join(leads.select("code_v", "fp"), "fp").select("code_u", "code_v")
    near = leads.select(F.col("code_v").alias("code_u"), F.col("head").alias("code_v"))
    return _ordered(alike.unionByName(near).where("code_u <> code_v")).distinct()


def _similar(docs: DataFrame, sets: DataFrame, classes: DataFrame, *, bucket: int, pivots: int = 4, **rule) -> DataFrame | None:
    """``node`` (a code) and ``root`` of the sets that have a verified link; None if no set has a shingle.

    Links are looked for in two steps: by fingerprints and to pivots of crowded buckets, then all pairs of different components.
    """
    count, total = sets.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return None
    few = _tasks(count)
    alive = cut(_alive(docs, sets, total, **{c: rule[c] for c in ("text", "words", "similarity")}).coalesce(few))
    postings = cut(_postings(docs, sets, alive, **rule))
    enough, links, nodes = _enough(rule["similarity"]), [], postings.select("*", F.col("code").alias("root"), F.lit(None).cast("long").alias("big"))
    found = _print_pairs(classes, few)
    if (held := _pivot_pairs(postings, enough, bucket, pivots)) is not None:
        found = found.unionByName(held).distinct()
    if not (found := cut(found.coalesce(few))).isEmpty():
        joined = cut(components(_verified(docs, sets, found, **rule)).coalesce(few))
        large = cut(joined.groupBy("root").count().where(F.col("count") > bucket).select("root", F.col("root").alias("big")).coalesce(few))
        told = joined.join(sent_if_few(large), "root", "left").select(F.col("node").alias("code"), "root", "big")
        nodes = cut(postings.join(told, "code", "left").select("token", "code", "n", "rest", F.coalesce("root", "code").alias("root"), "big"))
        links.append(joined.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links.append(_verified(docs, sets, cut(_pairs(nodes, enough)), **rule))
    return cut(components(reduce(DataFrame.unionByName, links)).coalesce(few))


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bucket: int = 128) -> tuple[DataFrame, DataFrame]:
    """``id`` and ``key`` of every row, and ``key``, ``copies``, ``least`` and ``root`` of every different text.

    Texts link if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more; rows of one
    root are linked, directly or through others.  Letters A-Z count as lower-case, and texts without words (null too) are
    one group.  ``least`` is the least id of the text's rows, null if none has one.  Equal sets go by a code of 64 bits:
    two of n different ones share it with a chance of about n^2 / 2^65.
    """
    rows = cut(_marked(docs, doc_id, text, words))
    few = _tasks(rows.count())
    classes = cut(rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("fp", "code", "n")], F.min("id").alias("least"), F.count("*").alias("copies")).coalesce(few))
    sets = cut(classes.groupBy("code").agg(F.first("n").alias("n"), F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("by")).coalesce(few))
    joined = _similar(docs, sets, classes, bucket=bucket, doc_id=doc_id, text=text, words=words, similarity=similarity)
    rooted = classes.withColumn("root", F.col("code")) if joined is None else classes.join(joined, F.col("code") == F.col("node"), "left").withColumn("root", F.coalesce("root", "code"))
    return rows.select("id", "key"), cut(rooted.select("key", "copies", "least", F.unhex(hex16(F.col("root"))).alias("root")).coalesce(few))


def keep_representatives(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of near copies (see :func:`near_copies`): the one with the least id.

    Rows without an id stand for a group only if no row of it has one; the least key of a text decides among texts
    with the same id.  Of rows that repeat both id and text, any one stays.  An empty table gives none.
    """
    rows, texts = near_copies(docs, doc_id=doc_id, text=text, **how)
    order = F.struct(F.col("least").isNull().alias("none"), "least", "key")
    best = texts.groupBy("root").agg(F.min(order).alias("b"), F.sum("copies").alias("rows"))
    id_, key = fresh(docs, "kept_id", "kept_key")
    if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():  # ids are unique: the others go by theirs
        several = texts.join(best.where(F.col("rows") > 1), "root").select("key", F.col("b.least").alias("stays"))
        lost = cut(rows.join(several, "key").where(F.col("id") != F.col("stays")).select(F.col("id").alias(id_)))
        return docs.join(sent_if_few(lost), F.col(f"`{doc_id}`") == F.col(id_), "left_anti")
    stay = best.select(F.col("b.least").alias(id_), F.col("b.key").alias(key))
    mine, = fresh(docs, "own_key")
    kept = docs.withColumn(mine, text_key(F.col(f"`{text}`"))).join(stay, (F.col(mine) == F.col(key)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)))
    return kept.dropDuplicates([mine]).select(*own(docs))


def hex16(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
