import random
import re
from itertools import permutations

from parcelight.llm import filter_audit as A


def failures(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for doc, text, source in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = doc is not None and any((o or "") == t and i is not None and i < doc for i, o, _ in docs)
        yield source or "", {f for f in fails if fails[f]}, doc in good, doc in toxic


def brute(docs, labels):
    rows = list(failures(docs, labels))
    out, shares = {}, {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def cases():
    rng = random.Random(3)
    docs = []
    for i in range(150):
        words = rng.choices(["w%d" % k for k in range(rng.choice([5, 900]))], k=rng.choice([0, 3, 199, 200, 320]))
        words += rng.choice([[], ["A" * 20], ["50%"], ["ÉTÉ"]])
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words), rng.choice(["x", "y", "", None])))
    docs += [(200 + i, docs[rng.randrange(60)][1], rng.choice(["x", "z"])) for i in range(40)]
    docs += [(None, docs[1][1], "x"), (3, docs[3][1], "x"), (3, "other #", "y"), (300, None, "q"), (301, "", "q"), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 190, 2)] + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_like_brute_force(spark):
    docs, labels = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = found(A.audit(frame, spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels) and len(got) == 600 * len({d[2] or "" for d in docs})


def test_clashing_names_and_empty_tables(spark):
    docs, labels = cases()
    plain = spark.createDataFrame(docs, "doc_id long, text string, source string")
    more = plain.selectExpr("*", "1 as part", "2 as mask", "3 as content", "'n' as least", "4 as good", "5 as quality")
    judged = spark.createDataFrame(labels, LABELS)
    assert found(A.audit(more, judged.selectExpr("*", "1 as text", "2 as source"))) == found(A.audit(plain, judged))
    assert A.audit(plain.limit(0), judged).collect() == []
    none = found(A.audit(plain, judged.limit(0)))
    assert all(v[4] == v[5] == 0 for v in none.values())


def test_passing_is_the_last_step(spark):
    docs, labels = cases()
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as _content", "2 as _LEAST")
    kept = A.passing(frame)
    want = {k[0]: v[0] for k, v in brute(docs, labels).items() if k[1:] == ("ABCDE", 5)}
    assert kept.columns == frame.columns
    assert {p: sum((r["source"] or "") == p for r in kept.collect()) for p in want} == want
    assert A.passing(frame, "D").count() == sum("D" not in f for _, f, _, _ in failures(docs, labels))


def test_edges():
    edges = A.lattice_edges()
    assert len(edges) == len(set(edges)) == 80 and all(not b & f for b, f in edges)
