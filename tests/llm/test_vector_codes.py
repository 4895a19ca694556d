import hashlib
import math
import random

import numpy as np
import pytest

from parcelight.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def lloyd(rows, rounds=2):
    """Plain Lloyd in Python integers: {row: (code, error)} and the codebooks."""
    kept = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(256 * x) for x in v] for _, v in kept]
    width = len(whole[0]) // 16
    parts = [[tuple(v[p * width : (p + 1) * width]) for v in whole] for p in range(16)]
    books = [part[:64] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            at = [near(x, books[p])[1] for x in parts[p]]
            for e in set(at):
                own = [x for x, k in zip(parts[p], at) if k == e]
                books[p] = [tuple(sum(c) // len(own) for c in zip(*own)) if k == e else old for k, old in enumerate(books[p])]
    found = [[near(x, books[p]) for p, x in enumerate(column)] for column in zip(*parts)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(kept[k][0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for k, f in enumerate(found)), digest


def vectors(n, width, spread, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(16 * width)] for _ in range(7)]
    return [(3 * i + 1, [c + rng.gauss(0, spread / 5) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]


def coded(spark, rows):
    df, books, scans = V.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = df.collect()
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    return sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got), books.digest() if books else None, scans


@pytest.mark.parametrize("n,width,spread", [(500, 2, 0.3), (64, 1, 0.1), (20, 3, 5.0), (1, 1, 1.0), (300, 1, 0.004), (200, 1, 40_000.0)])
def test_like_plain_lloyd(spark, n, width, spread):
    rows = vectors(n, width, spread)
    got, digest, _ = coded(spark, rows)
    assert (got, digest) == lloyd(rows)


def test_odd_rows(spark):
    rows = vectors(120, 1, 0.3)
    bad = [(0, None, 1), (-1, [float("nan")] * 16, 1), (-2, [float("inf")] + [0.0] * 15, 1), (-3, [None] + [0.0] * 15, 1), (-4, [], 1)]
    again = [rows[5], rows[5], (None, rows[7][1], None), (rows[9][0], [0.5] * 16, 3)]
    got, digest, _ = coded(spark, rows + bad + again)
    assert (got, digest) == lloyd(rows + bad + again) and len(got) == 124
    assert coded(spark, bad)[0] == [] and V.compress(spark.createDataFrame([], SCHEMA))[0].collect() == []
    more = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as code", "2 as _raw", "3 as _codes", "4 as error")
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in V.compress(more)[0].collect()) == lloyd(rows)[0]


def test_errors(spark):
    with pytest.raises(Exception, match="one length"):
        V.compress(spark.createDataFrame([(1, [0.0] * 16, 1), *[(k, [0.0] * 16, 1) for k in range(2, 70)], (99, [0.0] * 32, 1)], SCHEMA))
    with pytest.raises(Exception, match="magnitude"):
        V.compress(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA))


def test_heaps_spare_scans_and_never_err():
    """Codes and keys carried over many small moves equal full scans; few parts are scanned."""
    rng = np.random.default_rng(5)
    x = (rng.integers(-8, 9, (3000, 16, 1)) * 40 + rng.integers(-6, 7, (3000, 16, 4))).astype(np.int64)
    books = V.Books(np.ascontiguousarray(x[:64].swapaxes(0, 1)), np.zeros((16, 64)))
    codes, keys, _ = V.assigned(x, books, None, None)
    scans = []
    for _ in range(5):
        books = books.moved(books.entries + rng.integers(-1, 2, books.entries.shape))
        codes, keys, n = V.assigned(x, books, codes, keys)
        assert (codes == V.assigned(x, books, None, None)[0]).all()
        scans.append(n)
    assert min(scans) < 0.9 * x.shape[0] * 16
