import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelight.llm import exact_dedup as E

NAMES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def expected(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(plain, []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for plain, members in groups.items():
        best = min(m[:3] for m in members)
        for k, (_, null, doc, _) in enumerate(sorted(members)):
            out.append((None if null else doc, None if best[1] else best[2], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def rows():
    rng = random.Random(7)
    words = ["a", "b", "été", "x" * 5000, "数", "\U0001f600"]
    texts = [rng.choice([" ", "\n", "", "\t\x0b\x0c\r"]).join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(5, "a b"), (5, "a b"), (None, "a b"), (None, None), (400, None), (401, " \n"), (402, "a b"), (403, "é" * 3), (404, "é" * 3)]


#: With the weak hashes most texts collide.
@pytest.mark.parametrize("hashed", [E.content_hash, lambda p: F.length(p) % 3, lambda p: F.lit(1)])
def test_like_brute_force(make_docs, hashed):
    own = rows()
    docs = make_docs([t for _, t in own], [d for d, _ in own])
    assert found(E.mark_copies(docs, ["doc_id"], hashed)) == expected(own)


def test_a_hot_group_keeps_one(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    marked = E.mark_copies(docs)
    assert marked.filter("kept").count() == 20_000 - 6667 + 1
    assert {tuple(r) for r in marked.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(0, 6667)}


def test_columns(make_docs):
    docs = make_docs(["a", "A", "a "], kept=1, _h="x", keep_id="y", _plain="z", Group_Size=2)
    marked = E.mark_copies(docs)
    assert len(marked.columns) == len(set(c.lower() for c in marked.columns)) and "_plain" in marked.columns
    left = E.without_copies(docs)
    assert left.columns == docs.columns and {(r["doc_id"], r["kept"], r["Group_Size"]) for r in left.collect()} == {(1, 1, 2), (2, 1, 2)}
    assert E.mark_copies(make_docs([])).collect() == [] and E.without_copies(make_docs([])).collect() == []
