import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelight.llm import decontamination as D


def brute(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = norm(text), set(), set()
    for item, t in items:
        w = norm(t)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=20), max_size=4), st.lists(st.sampled_from("abcd"), max_size=60))
def test_search_equals_brute_force(items, words):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    spans, found = D.Benchmark(items).hits(words)
    n, hit, ids = brute(" ".join(words), items)
    assert sum(b - a for a, b in spans) == hit and sorted(map(str, found)) == ids


@pytest.mark.parametrize("block_chars", [1 << 20, 200])
def test_corpus(spark, corpus, texts, block_chars):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rows = D.find_contamination(corpus, bench, block_chars).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, ids = brute(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == (n, hit, ids)
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_one_block_at_a_time(spark, make_docs):
    bench = spark.createDataFrame([(i, f"first{i} second{i} third{i}") for i in range(12)], "item_id long, text string")
    docs = make_docs(["a first3 second3 third3 b first7 second7 third7", "first1 second2 third3"])
    assert len(D.item_blocks(bench, 100)) > 2
    found = D.find_contamination(docs, bench, 100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("find(") == 1
    assert sorted((r["n_hit"], r["item_ids"]) for r in found.collect()) == [(0, []), (6, ["3", "7"])]


def test_memory_of_a_block():
    """A block's tables stay within some 60 bytes a word; texts are searched in time linear in their length."""
    import random
    import tracemalloc

    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=100))) for i in range(3_000)]
    tracemalloc.start()
    bench = D.Benchmark(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * 300_000 + 200 * 20_000
    words = items[7][1].split()
    assert bench.hits([*rng.choices(vocabulary, k=300_000), *words[20:50], "end"]) == ([(300_000, 300_030)], {7})


def test_query_columns(spark):
    rows = D.query(spark, "/root/testdata/sf0.001").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert any(r["contaminated"] for r in rows)
    assert all((r["items_sha256"] == none) == (r["n_items"] == 0) for r in rows)


def test_odd_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "Ein WORT"), (3, "ein wort"), (4, "solo")], "item_id long, text string")
    docs = make_docs([None, "", "b. ein-wort c", "Solo", "x y", "w " * 40_000], [1, 1, None, 4, 5, 6], n_words="old", item_ids="old")
    rows = D.find_contamination(docs, bench).collect()
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in rows]
    assert sorted(got, key=str) == sorted([(1, 0, 0, []), (1, 0, 0, []), (None, 4, 2, ["3"]), (4, 1, 1, ["4"]), (5, 2, 0, []), (6, 40_000, 0, [])], key=str)
    assert D.find_contamination(make_docs([]), bench).collect() == []
    assert not any(r["contaminated"] for r in D.find_contamination(docs, bench.limit(0)).collect())
    assert D.remove_contaminated(docs, bench).columns == docs.columns
    clash = D.find_contamination(make_docs(["solo"], _found="kept"), bench).collect()[0]
    assert (clash["_found"], clash["n_hit"]) == ("kept", 1)
