"""The trie against plain sets of prefixes, and the radix tree against sorted keys."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cellweave.llm import prefixtrie
from cellweave.llm.radix import Beside, Direct, Indexed, Tree


def plain(convs):
    """convs: {conv_id: [(turn's identity, code points), ...]}"""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(t for t, _ in turns[:d]), []).append((c, len(turns) == d, turns[d - 1][1] if d else 0))
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * nodes[p][0][2]
        below[p] = (sum(below[q][0] for q in kids.get(p, [])) or 1, own + sum(below[q][1] for q in kids.get(p, [])))
    least = {p: min(c for c, _, _ in m) for p, m in nodes.items()}
    out = []
    for p, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c, e, _ in m if e)))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    order = {c: [(t[2], t[3]) for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in order.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = [(t, len(t[1])) for t in order.get(c - c % 100, [])[:h] + ts[h:]]
    return out


def table():
    rnd = random.Random(11)
    rows, said = [], ["hello", "", "é" * 3, "a long answer", None, "yes"]
    for c in range(260):
        rows += [(c, k, rnd.choice(["user", "assistant"]), rnd.choice(said)) for k in range(rnd.randint(1, 7))]
    for c in range(300, 420):  # equal conversations
        rows += [(c, k, "user", f"same {k}") for k in range(9)]
    rows += [(500, k, "user", f"long {k}") for k in range(300)] + [(600, k, "user", f"long {k}") for k in range(290)]
    rows += [(700, None, "user", "first"), (700, 0, None, "second"), (None, 0, "user", "nobody's"), (1001, 0, "user", "x"), (1007, 0, "user", "x"), (2**40, 3, "r", "t")]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "part", "turns", "node")}).repartition(3)
    convs = prefixtrie.turns_in_order(df)
    c = F.col("conv_id")
    again = prefixtrie.with_heads(convs, c - c % 100, (F.crc32(c.cast("string")) % 6).cast("int"), 5)
    return sorted((tuple(r) for r in prefixtrie.prefix_nodes(prefixtrie.keyed(again), **how).collect()), key=repr)


@pytest.mark.parametrize("per_part", [50_000, 40, 7])
def test_nodes_equal_plain_prefixes(spark, per_part):
    assert run(spark, table(), per_part=per_part) == plain(rebuilt(table()))


def test_one_conversation_and_none(spark):
    one = [(3, 0, "user", "hi")]
    assert run(spark, one) == plain(rebuilt(one))
    assert run(spark, one[:0]) == []


def test_lists_longer_than_a_part(spark, monkeypatch):
    rows = [(c, 0, "user", "x") for c in range(100, 3000)]
    assert run(spark, rows, per_part=300) == plain(rebuilt(rows))


def test_radix_tree_grows_and_keeps_every_key():
    rnd = random.Random(2)
    keys = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 9))) for _ in range(300)} | {b"k" + bytes([b]) + b"tail" for b in range(256)}
    keys |= {b"m" + bytes([b]) for b in range(40)} | {b"n" + bytes([b]) for b in range(12)}
    tree = Tree()
    for k in rnd.sample(sorted(keys), len(keys)):
        tree.insert(k, k)
    walk = tree.walk()
    found = [n.value for n, _, _ in walk if n.value is not None]
    assert found == sorted(keys)
    assert all(len(n.value) == end for n, _, end in walk if n.value is not None)
    assert {type(n.layout) for n, _, _ in walk} == {Beside, Indexed, Direct}
    assert {n.layout.room for n, _, _ in walk} == {4, 16, 48, 256}
    assert all(n.value is not None or len(n.layout.pairs()) > 1 for n, _, _ in walk)
