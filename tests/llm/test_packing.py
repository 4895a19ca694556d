import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelight.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.default_tokenizer())


def test_ids_equal_the_tokenizers(texts, tokenizer):
    encoder = P.Encoder(P.default_tokenizer())
    assert encoder.fast is not None
    odd = ["", " ", "  a  b ", "a\n\n b\t", "don't I'll  x", "<|endoftext|> a", "é ü 12345 !!!", "　字 字字", "x" * 500, "a\r\n \r\n b", "\x1c\x1d a  b"]
    for text in [*texts.values(), *odd]:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_best(counts, room):
    used = P.fullest(counts, room)
    pool = [n for n, c in counts.items() for _ in range(c)]
    best = max(sum(x) for k in range(len(pool) + 1) for x in itertools.combinations(pool, k) if sum(x) <= room) if len(pool) < 12 else None
    total = sum(n * k for n, k in used.items())
    assert total <= room and all(k <= counts[n] for n, k in used.items())
    assert best is None or total == best


def check(rows, texts, tokenizer, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert own[0]["start"] == 0 and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["length"] == capacity or r["piece"] == 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_packing_is_whole_and_tight(spark, corpus, texts, tokenizer):
    rows = P.packed(spark, corpus).collect()
    n, tokens = check(rows, texts, tokenizer, P.CAPACITY)
    assert n <= 1.01 * -(-tokens // P.CAPACITY) + 1  # the sum of the pieces is a lower bound


def test_odd_rows(spark, make_docs, tokenizer):
    texts = {0: None, 1: "", 2: "a b c", 3: "a " * 3000, None: "z"}
    rows = P.packed(spark, make_docs(list(texts.values()), list(texts), piece="x", length=1)).collect()
    check(rows, texts, tokenizer, P.CAPACITY)
    assert P.packed(spark, make_docs([])).collect() == []
    twice = P.packed(spark, make_docs(["a b", "a b"], [7, 7])).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    ids = P.token_pieces(make_docs(["a b"]), keep_ids=True).collect()[0]["ids"]
    assert ids == [*tokenizer.encode("a b").ids, 2]


def test_long_runs(spark, make_docs, tokenizer):
    texts = dict(enumerate([" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "7" * 1_000_000, "x " * 500_000, " " * 400_000 + "x"]))
    check(P.packed(spark, make_docs(list(texts.values()))).collect(), texts, tokenizer, P.CAPACITY)


def test_common_length_in_many_parts(spark, make_docs, tokenizer):
    texts = dict(enumerate(["a b"] * 900 + ["a b c"] * 40))
    pieces = P.token_pieces(make_docs(list(texts.values()))).cache()
    rows = P.pack(spark, pieces, rows=5).collect()  # 180 parts
    n, tokens = check(rows, texts, tokenizer, P.CAPACITY)
    assert n == -(-tokens // P.CAPACITY)
