import random
from collections import defaultdict

import numpy as np
import pytest

from parcelight.llm import ngram_join as N


def shingles(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    """(doc_id, text) rows to (doc_id, class_id, n_links, n_copies)."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    links, parent = [[] for _ in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                links[i].append(j)
                links[j].append(i)
                parent[root(i)] = root(j)
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    top = defaultdict(lambda: None)
    for i in range(len(docs)):
        r = root(i)
        if top[r] is None or key(i) < key(top[r]):
            top[r] = i
    return [(docs[i][0], docs[top[root(i)]][0], len(links[i]), sum(sets[i] == sets[j] for j in links[i])) for i in range(len(docs))]


def check(df, docs):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute(docs), key=str)


def copies(seed, groups=12, most=14, words=60):
    rng, docs = random.Random(seed), []
    vocabulary = ["".join(rng.choices("abcdefg", k=4)) for _ in range(300)]
    common = [rng.choice(vocabulary) for _ in range(20)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        if rng.random() < 0.7:
            base = base[: len(base) // 2] + common + base[len(base) // 2 :]
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((rng.randint(0, 10**6), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_random_groups(make_docs, seed):
    docs = copies(seed)
    check(make_docs([t for _, t in docs], [i for i, _ in docs]), docs)


def test_blocks_and_crowded_nodes(make_docs, monkeypatch):
    docs = copies(9, groups=3, most=90)
    monkeypatch.setattr(N, "BLOCK", 20)
    monkeypatch.setattr(N.candidate_edges, "__defaults__", (30, 8, N.MISS))
    check(make_docs([t for _, t in docs], [i for i, _ in docs]), docs)


def test_empty_blocks(make_docs, monkeypatch):
    docs = [(2 * g + k, " ".join(f"w{g}x{i}" for i in range(60)) + " end" * k) for g in range(12) for k in range(2)]
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 60)  # two blocks for each pair, which often share one of them
    check(make_docs([t for _, t in docs], [i for i, _ in docs]), docs)


def lone_pairs(seed, pairs):
    """Texts of which 2 i and 2 i + 1 have a similarity of 36 / 45."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    out = []
    for i in range(pairs):
        same = [word() for _ in range(40)]
        out += [(2 * i, " ".join(same + [word() for _ in range(4)])), (2 * i + 1, " ".join(same + [word() for _ in range(5)]))]
    return out


@pytest.mark.parametrize("miss, least, most", [(1.0, 0.97, 0.9999), (N.MISS, 0.997, 1)])
def test_recall_at_full_depth(make_docs, monkeypatch, miss, least, most):
    docs = lone_pairs(4, 1200)
    monkeypatch.setattr(N.candidate_edges, "__defaults__", (N.NODE, 0, miss))  # all nodes split six times
    rows = N.near_duplicates(make_docs([t for _, t in docs], [i for i, _ in docs])).filter("doc_id % 2 = 1").collect()
    assert {r["n_links"] for r in rows} <= {0, 1}
    assert least <= sum(r["class_id"] == r["doc_id"] - 1 for r in rows) / 1200 <= most


def test_crowded_end_of_path(spark):
    """Sets of one path to its end, in pairs of like sketches: all pairs meet, though the node is dealt into parts."""
    rng, rows = np.random.default_rng(5), []
    for i in range(60):
        low, high = (int(x) for x in rng.integers(-(1 << 62), 1 << 62, 2))
        rows += [(2 * i, 30, [7] * 64, low, high), (2 * i + 1, 30, [7] * 64, low, high)]
    sets = spark.createDataFrame(rows, "cls long, n long, values array<int>, low long, high long")
    found = {tuple(sorted(r)) for r in N.candidate_edges(sets, 20, 4).collect()}
    assert found == {(2 * i, 2 * i + 1) for i in range(60)}


def test_corpus(corpus, texts):
    check(corpus, list(texts.items()))


def test_odd_rows(make_docs):
    a = " ".join(f"w{i}" for i in range(40))
    docs = [(1, None), (2, ""), (3, " \n"), (None, a), (5, a), (5, a), (5, a + " x"), (7, "one two"), (8, "one  two"), (9, "one"), (10, "v " * 30_000), (11, "v " * 29_000), (12, "q " * 4)]
    df = make_docs([t for _, t in docs], [i for i, _ in docs], class_id="x", cls=1, _id="y", _times=4)
    check(df, docs)
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [1, 2, 3, 5, 7, 9, 10, 12]
    assert N.near_duplicates(make_docs([])).collect() == [] and N.one_of_each(make_docs([])).collect() == []


def test_likenesses_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(90)]
    first = np.cumsum([0, *map(len, sets)])
    got = N.likenesses(np.concatenate(sets), first)
    for i in range(90):
        for j in range(90):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
