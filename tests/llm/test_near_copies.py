"""Near copies by SimHash candidates and five-word shingles, against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import simhash

from . import brute


def family(draw, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.choice(edits)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for size, n, edits in ((200, 120, (0, 1, 2, 3, 4, 5)), (60, 60, (1, 2)), (12, 60, (1,)), (1500, 6, (5, 20, 30))):
        texts += family(draw, [word() for _ in range(size)], n, edits)
    chain = [word() for _ in range(100)]
    for k in range(40):  # each like its neighbours only
        texts.append(" ".join(chain))
        chain[(7 * k) % 100] = f"y{k}"
    texts += [" ".join([*"a very common first line of many words".split(), *(word() for _ in range(2 + k % 40))]) for k in range(60)]
    return texts


@pytest.mark.parametrize("bucket", [128, 6])
def test_against_all_pairs_with_crowded_buckets(spark, texts, bucket):
    rows = list(enumerate(texts, 1))
    random.Random(6).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "a", b"b", 3) for i, t in rows], "doc_id long, text string, id string, key binary, kept_id int")
    kept = simhash.keep_representatives(docs, bucket=bucket)
    assert kept.columns == docs.columns
    roots, _ = brute.near_copies(texts)
    got = sorted(r.doc_id for r in kept.collect())
    assert {k + 1 for k in roots} <= set(got)  # of each true group the first stays, and nothing else is dropped
    caught, all_ = len(texts) - len(got), len(texts) - len(set(roots))
    assert caught >= 0.98 * all_


def told(spark, texts, **how):
    rows, keys = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how)
    found = {r.id: bytes(r.root) for r in rows.join(keys, "key").select("id", "root").collect()}
    return [found[i] for i in range(len(texts))]


def recall(pairs, root):
    return sum(root[i] == root[j] for i, j in pairs) / len(pairs)


def test_recall_of_true_pairs_of_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    least, pairs = brute.near_copies(texts)
    different = [(i, j) for i, j in pairs if texts[i] != texts[j]]
    assert len(different) >= 5
    root = told(spark, texts)
    assert recall(different, root) >= 0.95
    assert all(least[i] == least[j] for i in range(len(texts)) for j in range(i) if root[i] == root[j])


@pytest.mark.parametrize("bucket", [128, 8])
def test_recall_of_pairs_just_similar(spark, bucket):
    """Pairs at 0.80 to 0.87, of many lengths, among texts of one template that are like each other at 0.5 to 0.7."""
    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(3000)}"
    frame, texts = [word() for _ in range(120)], []
    for size in (40, 60, 90, 150, 300, 800):
        for _ in range(12):
            a = [word() for _ in range(size)]
            b = list(a)
            for at in draw.sample(range(0, size, 5), max(1, round(size * 0.1 / 5))):
                b[at] = word()
            texts += [" ".join(a), " ".join(b)]
    for _ in range(150):
        w = list(frame)
        for at in draw.sample(range(0, 120, 6), 5):
            w[at] = word()
        texts.append(" ".join(w))
    least, pairs = brute.near_copies(texts)
    assert len(pairs) > 50
    root = told(spark, texts, bucket=bucket)
    assert recall(pairs, root) >= 0.95
    assert all(least[i] == least[j] for i in range(len(texts)) for j in range(i) if root[i] == root[j])


@pytest.mark.parametrize("bucket", [128, 8])
def test_no_pair_at_the_bound_is_lost(spark, bucket):
    """Pairs at 0.8 and little above it, of 10 to 400 words and of unlike lengths, all of them."""
    draw = random.Random(33)
    word = lambda: f"w{draw.randrange(3000)}"
    texts = []
    for size in (10, 14, 25, 50, 100, 400):
        for _ in range(25):
            a = [word() for _ in range(size)]
            shingles = size - 4
            b = a + [word() for _ in range(shingles // 4)]  # a whole in b: 0.8 where 4 divides
            c = list(a)
            for at in range(2, size, 45):  # five shingles of 45 each
                c[at] = word()
            texts += [" ".join(x) for x in (a, b, c)]
    least, pairs = brute.near_copies(texts)
    assert len(pairs) > 150
    root = told(spark, texts, bucket=bucket)
    assert recall(pairs, root) == 1
    assert all(least[i] == least[j] for i in range(len(texts)) for j in range(i) if root[i] == root[j])


def test_candidates_follow_the_texts_of_a_crowd(spark, monkeypatch):
    """A template, near copies of it and texts with too many words of their own: few pairs a text are compared."""
    draw = random.Random(34)
    base = [f"w{draw.randrange(5000)}" for _ in range(140)]
    texts = [" ".join(base), *family(draw, base, 300, (1, 2, 3)), *family(draw, base, 300, (5, 6))]
    compared, verified = [], simhash._verified

    def counted(docs, sets, pairs, **rule):
        compared.append(pairs.count())
        return verified(docs, sets, pairs, **rule)

    monkeypatch.setattr(simhash, "_verified", counted)
    least, pairs = brute.near_copies(texts)
    root = told(spark, texts, bucket=16)
    assert recall(pairs, root) == 1
    assert sum(compared) < 8 * len(texts)


def test_the_stage_runs_the_fingerprint_operator_and_verifies_what_it_links(spark, monkeypatch):
    """Texts that :func:`simhash.near_duplicates` joins are compared first; those below the similarity stay apart."""
    draw = random.Random(35)
    words = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    long, phrase = words(400), words(5) * 60
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(phrase), " ".join([*phrase, *words(4)]), *(" ".join(words(60)) for _ in range(20)), "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [brute.fingerprint(t) for t in texts]
    by_print = brute.linked(fps)
    assert by_print[1] == 0 and by_print[3] == 2 and len(set(fps[:4])) > 2  # the operator joins both pairs
    ran, compared, operator, verified = [], [], simhash.near_duplicates, simhash._verified
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **how: (ran.append(how), operator(*a, **how))[1])

    def seen(docs, sets, pairs, **rule):
        compared.append(pairs.count())
        return verified(docs, sets, pairs, **rule)

    monkeypatch.setattr(simhash, "_verified", seen)
    least, _ = brute.near_copies(texts)
    assert least[1] == 0 and least[3] == 3
    root = told(spark, texts)
    assert [root.index(x) for x in root] == least
    assert ran and compared[0] == 2
    assert sorted(r.doc_id for r in simhash.keep_representatives(rows).collect()) == sorted(set(least))


def test_equal_sets_meet_by_their_code(spark):
    """Texts that differ in blanks, case and repetition only, and texts without a word."""
    line = "one two three four five six seven eight"
    texts = [line, line.upper(), line.replace(" ", "\n"), f"{line} ", f"{line} {line}", None, "", " ", "\t\n", "one two", "One\ttwo", "one two three"]
    least, _ = brute.near_copies(texts)
    root = told(spark, texts)
    assert [root.index(x) for x in root] == least


def test_signatures_follow_the_similarity():
    rnd = np.random.default_rng(4)
    for shared, alone in ((0, 100), (60, 20), (160, 20), (8, 1)):
        same = []
        for _ in range(40):
            both = rnd.integers(0, 2**63, shared + 2 * alone, dtype=np.uint64)
            sets = [both[: shared + alone], np.concatenate([both[:shared], both[shared + alone :]])]
            sigs = simhash.signatures(np.concatenate(sets), np.array([0, shared + alone, 2 * (shared + alone)]))
            same.append(sum(int(x[0] ^ x[1]).bit_count() if x[0] ^ x[1] >= 0 else (int(x[0] ^ x[1]) & (2**64 - 1)).bit_count() for x in sigs))
        jaccard = shared / (shared + 2 * alone)
        assert np.mean(same) == pytest.approx(128 * (1 - jaccard), abs=6)


def test_several_large_groups_find_each_other(spark):
    draw = random.Random(9)
    base = [f"w{draw.randrange(5000)}" for _ in range(160)]
    texts = []
    for k in range(5):  # five groups along a path of edits
        texts += family(draw, base, 25, (0, 1))
        for j in range(6):
            base[(29 * k + 5 * j) % 160] = f"z{k}{j}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, _ = brute.near_copies(texts)
    assert sorted(r.doc_id for r in simhash.keep_representatives(docs, bucket=8).collect()) == sorted(set(roots))


def test_ids_that_are_null_repeated_or_text(spark):
    t = "a b c d e f g h i j"
    rows = [(None, t), (7, t), (7, t), (7, t.upper()), (7, "other words stand here now"), (None, "lone"), (None, "lone"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, x, x, 1, 2, 3) for i, x in rows], "doc_id long, text string, _id string, _fp int, _mine int, _root int")
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in simhash.keep_representatives(docs).collect())
    assert got == [(0, "lone"), (3, ""), (7, t), (7, "other words stand here now")]
    assert simhash.keep_representatives(docs.where(F.lit(False))).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    assert sorted(r.doc_id or "" for r in simhash.keep_representatives(named).collect()) == ["", "doc-3", "doc-7", "doc-7"]
    assert {r.component_id for r in simhash.near_duplicates(named).collect()} >= {"doc-3", "doc-7"}
