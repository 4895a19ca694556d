import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from parcelight.llm import recompression as R
from parcelight.llm import substring_dedup as S
from parcelight.llm.batches import small_batches


def brute(docs, window=50):
    """(doc_id, text) pairs to (doc_id, n_words, n_removed, kept) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            s = tuple(w[k : k + window])
            least[s] = min(i, least.get(s, i))
    for (i, _), w in zip(docs, words):
        drop = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                drop.update(range(k, k + window))
        yield i, len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop)


def check(df, docs):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(df).collect()), key=str)
    assert got == sorted(brute(docs), key=str)


def random_docs(seed, n=60, alphabet=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh é", k=rng.randint(1, 7))).replace(" ", "") or "q" for _ in range(alphabet)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(49, 140))] for _ in range(6)]
    passages.append(["na"] * 130)
    passages.append(["a", "b"] * 60)
    docs = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 70))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            p = p[a : len(p) - rng.randint(0, len(p) // 3)]
            if rng.random() < 0.4:
                p = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in p]
            words += p
        docs.append((rng.randint(0, 10**6), rng.choice([" ", "\n", " \t "]).join(words)))
        if rng.random() < 0.15:
            docs.append((rng.randint(0, 10**6), docs[-1][1]))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_random_passages(make_docs, seed):
    docs = random_docs(seed, alphabet=400 if seed < 3 else 3)
    check(make_docs([t for _, t in docs], [i for i, _ in docs]), docs)


@pytest.mark.parametrize("window", [R.SHORTEST, 64, 100, 200])
def test_other_windows(make_docs, window):
    rng = random.Random(window)
    passage = [f"w{rng.randint(0, 50)}" for _ in range(450)]
    texts = [" ".join([f"x{i}"] * 3 + passage[rng.randint(0, 60) : rng.randint(300, 450)] + [f"y{i}", "z"]) for i in range(12)] + ["a b " * 200] * 2
    docs = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in S.remove_repeats(make_docs(texts), window).collect())
    assert got == sorted(brute(docs, window)) and sum(r[2] for r in got) > 0


def test_windows_too_short(make_docs):
    with pytest.raises(ValueError):
        S.remove_repeats(make_docs(["a"]), R.SHORTEST - 1)


def test_corpus_and_query(spark, corpus, texts):
    rows = S.query(spark, "/root/testdata/sf0.001").collect()
    want = {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(list(texts.items()))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
    assert sum(r["n_removed"] for r in rows) > 0


def test_odd_rows(make_docs):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [(3, long), (1, None), (2, ""), (None, long), (5, "x " + long), (5, long + " y"), (5, long + " y"), (7, "short text"), (9, "v " * 30_000), (8, "v " * 100), (4, " ".join(f"w{i}" for i in range(49)))]
    check(make_docs([t for _, t in docs], [i for i, _ in docs], kept="x", anchor=1, at=2, _doc=3, _gone="y"), docs)
    assert S.remove_repeats(make_docs([])).collect() == []


def test_equal_windows_choose_equal_symbols():
    rng = random.Random(5)
    shared = [rng.choice("abcdefghijkl") + str(rng.randint(0, 9)) for _ in range(50)]
    names = set()
    for n in range(300):
        left, right = ([rng.choice("abcdefghijkl") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80))] for _ in "ab")
        if n % 3 == 0:
            left = left + [shared[0]] * rng.randint(0, 5)
        words = R.words_of([" ".join(left + shared + right)])
        blocks = R.window_blocks(words, 50)
        k = np.searchsorted(blocks.first, len(left), side="right") - 1
        assert blocks.first[k] <= len(left) < blocks.first[k] + blocks.count[k]
        names.add(int(blocks.anchor[k]))
    assert len(names) == 1


def test_kernel_words_equal_the_pattern():
    texts = ["", None, " a\x0bb\x0cc\r\nd ", "é ü x y", "\x1c\x1d a", "a"]
    words = R.words_of(texts)
    counts = np.diff(words.first)
    assert counts.tolist() == [len(S.WORD.findall(t or "")) for t in texts]


def thue_morse(n, letters):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return [letters[b] for b in bits[:n]]


@pytest.mark.parametrize("n", [64, 1024, 4096, 8192])
def test_regular_sequences_differ(n):
    """Sums of powers modulo 2 ** 64 cancel for these, whatever the base."""
    a, b = "".join(thue_morse(n, "ab")), "".join(thue_morse(n, "ba"))
    words = R.words_of([a, b])
    assert words.one[0] != words.one[1] and words.two[0] != words.two[1]
    words = R.words_of([" ".join(a), " ".join(b)])
    for k, values in enumerate((words.one, words.two)):
        one, two = R.range_hashes(values, np.array([0, n]), np.array([n, 2 * n]), k)
        assert one != two


def test_texts_that_differ_in_one_regular_word(make_docs):
    rest = [f"w{k}" for k in range(60)]
    texts = [" ".join([*rest[:30], "".join(thue_morse(4096, s)), *rest[30:]]) for s in ("ab", "ba")]
    assert [r["n_removed"] for r in S.remove_repeats(make_docs(texts)).collect()] == [0, 0]


def test_products_modulo_the_prime():
    rng = random.Random(2)
    a, b = ([0, 1, R.PRIME - 1, R.PRIME - 1, *[rng.randrange(R.PRIME) for _ in range(5000)]] for _ in range(2))
    a[0] = R.PRIME - 1
    got = R.times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % R.PRIME for x, y in zip(a, b)]


def test_slices_are_bounded_in_bytes():
    texts = ["x" * 3_000_000, "é" * 1_500_000, None, "", "y" * 9_000_000, *["short"] * 1200, "z" * 4_000_000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    slices = list(small_batches(iter([batch])))
    assert [t for s in slices for t in s["text"].to_pylist()] == texts
    assert all(s.num_rows == 1 or (s.num_rows <= 500 and sum(len((t or "").encode()) for t in s["text"].to_pylist()) <= 4 << 20) for s in slices)
    assert list(small_batches(iter([batch.slice(0, 0)]))) == []
