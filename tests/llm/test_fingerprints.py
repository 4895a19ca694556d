import hashlib
from collections import Counter

import numpy as np

from parcelight.llm import fingerprints as P


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    if not a and not b:
        return 1.0
    return sum((a & b).values()) / sum((a | b).values())


def brute(rows):
    """(doc_id, text) to (doc_id, text, edited, next), in descending doc_id, equal ids by text."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    for k, (i, t) in enumerate(order):
        after, h = order[(k + 1) % len(order)][1], len(t) // 2
        yield i, t, t[: len(t) - h] + after[:h], after


def check(got, rows):
    want = list(brute(rows))
    key = lambda r: str(r)
    a = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key)
    assert a == sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key)
    return want


def test_likeness_estimates_generalised_jaccard(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = P.query(spark, d).collect()
    want = {i: (t, e, after) for i, t, e, after in check(rows, docs.items())}
    errors = []
    for r in rows:
        t, e, after = want[r["doc_id"]]
        errors += [r["near_edited"] - jaccard(t, e), r["near_next"] - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.01
    assert np.sqrt(np.mean(np.square(errors))) < 0.5 / np.sqrt(P.SAMPLES)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_buckets_do_not_matter(corpus, texts):
    a, b = (sorted(P.compare_with_edited(corpus, buckets=n).collect()) for n in (1, 37))
    assert a == b
    check(a, texts.items())


def test_odd_rows(make_docs):
    rows = [(5, None), (None, "a b"), (3, ""), (3, "a a b"), (3, "a a b"), (9, " \n "), (7, "w " * 30_000), (8, "é😀x")]
    for n in (1, 3, 50):
        got = P.compare_with_edited(make_docs([t for _, t in rows], [i for i, _ in rows], bucket=1, sig="x"), buckets=n).collect()
        check(got, rows)
    same = [r["fingerprint"] for r in got if r["doc_id"] == 3 and r["n_chars"] == 5]
    assert same[0] == same[1]
    assert next(r for r in got if r["doc_id"] == 9)["fingerprint"] == "-"
    assert P.compare_with_edited(make_docs([])).collect() == []
    one = P.compare_with_edited(make_docs(["a b c d"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
