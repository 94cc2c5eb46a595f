import random
from collections import Counter

import numpy as np
import pytest

from lociforge.llm import jaccard
from lociforge.llm.common import connected_components, smallest_reachable
from lociforge.llm.wordscan import mix


def shingles(text, n):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    link = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    count = lambda k: sum(m != k and x is not None and bool(link(sets[k][1], s)) for m, (x, s) in enumerate(sets)) if sets[k][0] is not None else 0
    return sorted(((i, len(s), find(i) if i is not None else None, count(k)) for k, (i, s) in enumerate(sets)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.5:
            base += passage
        for _ in range(rnd.randint(1, 4)):
            x = list(base)
            for _ in range(rnd.randint(0, max(1, len(x) // 40))):
                x[rnd.randrange(len(x))] = word()
            rows.append((i, " ".join(x).title() if rnd.random() < 0.3 else "\n".join(x)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \t"), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "one two"), (None, "one"), (3, rows[3][1]), (i + 6, "x " * 5000)]


@pytest.mark.parametrize("n,percent,block", [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 80, 150)])
def test_against_brute_force(spark, n, percent, block):
    rows = corpus(n + percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(df, n, percent, block=block).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6), (2, "a b c d", 7, 8)], "doc_id long, text string, id long, n long")
    assert {(r["id"], r["component_id"]) for r in jaccard.jaccard_join(df, 3, 90).collect()} == {(1, 1), (2, 1)}
    kept = jaccard.distinct_documents(df, 3, 90)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]
    assert jaccard.jaccard_join(df.where("false"), 3, 90).count() == 0


def test_distinct_documents_keep_other_texts(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, None), (None, "a b c d e f"), (4, "z y x w v u")]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "a b c d e f"), (1, "q r s t u v"), (3, None), (None, "a b c d e f"), (4, "z y x w v u")])


def test_tree_equals_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64)
        for _ in range(4):
            x = base.copy()
            m = int(len(x) * rng.random() * 0.15)
            x[:m] = rng.integers(0, 2**63, m).astype(np.uint64)
            sets.append(np.unique(mix(x)))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(both := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(both))}
    for bits, pairs in ((jaccard.BITS, jaccard.PAIRS), (0, 7)):
        monkeypatch.setattr(jaccard, "BITS", bits)
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        found = [(int(i), int(j)) for a, b in jaccard.tree_links(sets, 80) for i, j in zip(a, b)]
        assert len(found) == len(set(found)) and {tuple(sorted(x)) for x in found} == want
    side = rng.integers(0, 2, len(sets))
    across = {tuple(sorted((int(i), int(j)))) for a, b in jaccard.tree_links(sets, 80, side) for i, j in zip(a, b)}
    assert across == {(i, j) for i, j in want if side[i] != side[j]}
    copies = rng.integers(1, 5, len(sets))
    count, edges = jaccard.linked_sets(sets, copies, 80)
    assert count.tolist() == [sum(int(copies[j]) for j in range(len(sets)) if tuple(sorted((i, j))) in want) for i in range(len(sets))]
    both = [smallest_reachable(np.array([a for a, _ in e]), np.array([b for _, b in e])) for e in (sorted(want), edges.tolist())]
    assert all(np.array_equal(x, y) for x, y in zip(*both))


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 3), (9, 9), (None, 4)] + [(1000, x) for x in range(900, 920)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, one_task=one_task).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 3, 7: 3, 3: 3, **{x: 900 for x in range(900, 920)}, 1000: 900}
    assert connected_components(df.where("false"), one_task=one_task).count() == 0


def test_equal_rows_in_tasks_of_their_own(spark):
    rows = [(1, "a b c d e")] * 4 + [(2, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r["id"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_join(df, 3, 90).collect()) == [(1, 1, 4)] * 4 + [(2, 1, 4)]
    assert [r["doc_id"] for r in jaccard.distinct_documents(df, 3, 90).collect()] == [1]
