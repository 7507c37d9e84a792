"""The manifest against a tree built plainly, and the frontier against it leaf by leaf."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cellweave.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """The root of some nodes, and for each the runs of siblings on its way: (digests to the left, to the right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 16):
            above.append(sha("".join(nodes[k : k + 16])))
        for leaf, place in enumerate(at):
            run = place // 16 * 16
            ways[leaf].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 16])))
            at[leaf] = place // 16
        nodes = above
    return nodes[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, sha("".join(map(told, r)))))
    order = sorted(groups, key=lambda s: b"" if s is None else b"s" + s.encode())
    subs = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[s] = climb([leaf for _, leaf in groups[s]])
    root, tops = climb([subs[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        out += [(r[0], leaf, subs[s][0], root, tuple(way + top)) for (r, leaf), way in zip(groups[s], subs[s][1], strict=True)]
    return out


def rows_of(n, sources):
    rnd = random.Random(n)
    rows = [(i * 3, rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 7]), rnd.choice([None, "", "Aé b", "Text %d" % i])) for i in range(n)]
    return [*rows, (None, None, None, None, None), (None, "a", "x", 1, "Null id"), rows[0], rows[0], (5, "ß", None, 1, "x" * 50_000)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels,n,sources", [(1, 600, ["a", "b", "ab", "é", None]), (2, 700, ["a"]), (3, 4200, ["a", "a", "a", "b"])])
def test_manifest_equals_a_plain_tree(spark, levels, n, sources):
    rows = rows_of(n, sources)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("grp", "at", "total", "root", "path", "digest")}).repartition(3)
    changed = F.when(F.col("doc_id") % 2 == 0, F.translate("text", manifest.UPPER, manifest.LOWER))
    out = manifest.manifest(docs, levels=levels, tampered=changed)
    path = F.col("path")
    got = out.withColumns({"folded": manifest.fold(F.col("leaf"), path), "proof": manifest.proof_of(path), "now": manifest.fold(F.col("shown"), path)}).collect()
    want = plain(rows)
    key = lambda x: (str(x[0]), x[1], x[4])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got), key=key) == sorted(want, key=key)
    texts = {(r[0], sha("".join(map(told, r)))): r for r in rows}
    for r in got:
        row = texts[r.doc_id, r.leaf]
        assert r.folded == r.root and r.proof == sha("".join(s.left + s.right for s in r.path))
        same = r.doc_id is None or r.doc_id % 2 or row[4] is None or row[4] == row[4].translate(str.maketrans(manifest.UPPER, manifest.LOWER))
        assert (r.now == r.root) == bool(same)


def test_empty_table_gives_no_rows(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300])
def test_frontier_grows_to_the_plain_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree = manifest.Frontier()
    for leaf in leaves:
        tree.append(leaf)
        assert all(len(run) < 16 for run in tree.open)
    root, ways = climb(leaves)
    assert tree.finish() == root and tree.witness == ways
