import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from parcelight.llm import line_dedup as L


def pieces(text):
    """Cut at punctuation and every 64 characters; those of less than 8 don't count."""
    clauses = re.split(r"[.,;:!?\n]", text)
    return [p for c in clauses for k in range(0, len(c), 64) if len(p := c[k : k + 64]) >= 8]


def brute(docs, least=L.LEAST_DOCUMENTS):
    """(doc_id, text) pairs to the numbers of the lines to drop per pair."""
    cut = {t: pieces(t) for _, t in docs if t}
    seen = Counter(p for _, t in docs if t for p in set(cut[t]))
    own = {t for _, t in docs if L.OWN * sum(seen[p] < least for p in set(cut.get(t, ()))) >= len(set(cut.get(t, ())))}
    lines = []
    for d in sorted(set(docs), key=str):
        for i, x in enumerate((d[1] or "").split("\n")):
            w = tuple("<*>" if re.search("[0-9]", y) else y for y in re.sub(r"[\t\x0b\x0c\r]", " ", x).strip(" ").split(" "))
            if any(c.isalpha() for y in w for c in y):
                lines.append((d, i, w, w))

    def recurring(rows, template):
        texts = defaultdict(set)
        for r in rows:
            if r[0][1] in own:
                texts[template(r)].add(r[0][1])
        return {t for t, p in texts.items() if len(p) >= least}

    same = recurring(lines, lambda r: r[2])
    leaves = defaultdict(list)
    for r in lines:
        if r[2] not in same and len(r[3]) >= L.LEAST_TOKENS:
            leaves[len(r[3]), r[3][: L.DEPTH]].append(r)
    alike = []
    for leaf, rows in leaves.items():
        if sum(r[0][1] in own for r in rows) >= least:
            for r in rows:
                for f in range(1, min(L.RUN, leaf[0] // L.SHARE) + 1):
                    alike += [(*r, (f, k, r[3][:k] + r[3][k + f :])) for k in range(L.DEPTH, leaf[0] - f + 1)]
    near = recurring(alike, lambda r: r[4])
    drop = defaultdict(set)
    for r in lines:
        if r[2] in same:
            drop[r[0]].add(r[1])
    for r in alike:
        if r[4] in near:
            drop[r[0]].add(r[1])
    return drop


def kept(text, drop):
    return text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)


def check(df, docs):
    drop = brute(docs)
    rows = L.drop_boilerplate(df).collect()
    assert sorted(((r["doc_id"], r["text"], r["kept"], r["n_removed"], r["n_lines"]) for r in rows), key=str) == sorted(
        ((i, t, kept(t, drop[i, t]), len(drop[i, t]), len((t or "").split("\n"))) for i, t in docs), key=str
    )
    return rows


def fixture():
    docs, word = [], lambda i, k: "".join(chr(97 + (i * 7919 + k * 104729 + j * 31 * (i + k)) % 26) for j in range(7))
    body = lambda i, n=2: [" ".join(word(i, 10 * m + k) for k in range(9)) for m in range(n)]
    for i in range(12):
        a, b = body(i)
        docs.append((i, "\n".join([a, "All rights are reserved here.", b, f"Page {i} of {i + 90} pages", f"Posted by {word(i, 77)} on this page yesterday"])))
    copied = "\n".join([*body(500, 3), "One line of its own"])
    docs += [(100 + i, copied) for i in range(15)]
    docs += [(200 + i, f"{copied}\nThe end of number {word(i, 5)}") for i in range(3)]
    return docs


def test_templates_go_and_copies_stay(make_docs):
    docs = fixture()
    rows = check(make_docs([t for _, t in docs], [i for i, _ in docs]), docs)
    assert all(r["n_removed"] == (3 if r["doc_id"] < 100 else 0) for r in rows)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(3, 8))) for _ in range(n))


def removed(make_docs, texts):
    docs = list(enumerate(texts))
    rows = check(make_docs(texts), docs)
    return {r["doc_id"]: set((r["text"]).split("\n")) - set(r["kept"].split("\n")) for r in rows}


def test_whole_blocks_go(make_docs):
    licence = [f"Licence line {words(k, 6)}." for k in range(6)]
    texts = ["\n".join([words(100 + i, 9), *licence, words(900 + i, 9)]) for i in range(60)]
    assert all(gone == set(licence) for gone in removed(make_docs, texts).values())
    spaced = ["\n\n".join([words(100 + i, 9), "All rights are reserved here.", words(900 + i, 9)]) for i in range(20)]
    assert all(gone == {"All rights are reserved here."} for gone in removed(make_docs, spaced).values())


def test_copies_lower_nothing(make_docs):
    """A third of the rows are copies, exact and near ones, of a text that holds the boilerplate too."""
    line = "This is licensed to everybody."
    big = [words(5000 + k, 12) + "." for k in range(12)]
    near = [[words(7000 + 10 * i, 12) if k == i % 12 else x for k, x in enumerate(big)] for i in range(24)]
    texts = ["\n".join([words(i, 15), line, words(700 + i, 15)]) for i in range(30)] + ["\n".join([*x, line]) for x in [big] * 40 + near]
    gone = removed(make_docs, texts)
    assert all(g == {line} for g in gone.values())


def test_short_lines_and_other_scripts(make_docs):
    footer = ["Read more", "Advertisement", "版权所有未经许可不得转载本网站内容", "left\tright", "* * *", "2024"]
    texts = ["\n".join([words(i, 15), *footer, words(700 + i, 15), words(800 + i, 30)]) for i in range(9)]
    assert all(gone == set(footer[:4]) for gone in removed(make_docs, texts).values())


def test_templates_share_a_leaf(make_docs):
    texts = ["\n".join([words(i, 20), *([f"Posted by {words(300 + i, 1)} on this page yesterday"] if i % 2 else [f"Posted by {words(400 + i, 1)} in category news today"])]) for i in range(40)]
    texts += [f"{words(90 + i, 20)}\nPosted by {words(500 + i, 5)}" for i in range(10)]
    gone = removed(make_docs, texts)
    assert all(len(g) == (1 if i < 40 else 0) for i, g in gone.items())


@pytest.mark.parametrize("prose", [0, 100, 3000, 20_000])
def test_other_lines_of_a_leaf_change_nothing(make_docs, prose):
    """40 templates among any number of lines of as many tokens that begin alike and use the same names."""
    names = [words(10 + i, 1) for i in range(13)]
    texts = [f"{words(i, 20)}\nPosted by {names[i % 13]} in category news today here" for i in range(40)]
    texts += ["\n".join([words(9000 + i, 20), *[f"Posted by {names[(i + k) % 13]} {words(20_000 + 60 * i + k, 5)}" for k in range(min(50, prose))]]) for i in range(prose // 50)]
    rows = L.drop_boilerplate(make_docs(texts)).collect()
    assert sum(r["n_removed"] for r in rows if r["doc_id"] < 40) == 40 and not any(r["n_removed"] for r in rows if r["doc_id"] >= 40)


def test_a_text_may_repeat_itself(make_docs):
    own = [f"A line of number {words(i, 4)}" for i in range(50)]
    gone = removed(make_docs, ["\n".join([own[i]] * 6 + ["This is a shared notice."]) for i in range(50)])
    assert all(g == {"This is a shared notice."} for g in gone.values())


def test_fields_of_several_words(make_docs):
    texts = [f"{words(i, 20)}\nThis text was written by {words(300 + i, 1 + i % 2)} for the paper on a day like this one\n{words(5, 3)} {words(800 + i, 2)} {words(6, 3)}" for i in range(20)]
    gone = removed(make_docs, texts)
    assert all(len(g) == 2 for g in gone.values())


def test_pieces(spark, make_docs):
    texts = [words(i, 60).replace(" ", sep).replace("e ", "e, ") + tail for i, (sep, tail) in enumerate(itertools.product((" ", "  ", " \t", ". ", "\n", " \r\n "), ("", " ", "\n", "!", " ... x")))]
    rows = make_docs(texts).selectExpr("text", f"regexp_extract_all(text, r'{L.PIECE}', 0) p").collect()
    assert all(r["p"] == pieces(r["text"]) for r in rows)


def test_long_texts(make_docs):
    texts = ["x" * 1_000_000 + " 1", "word " * 200_000, ("a line of text here\n" * 50_000), "1" * 500_000 + "\n" * 100_000, "a, " * 300_000]
    check(make_docs(texts), list(enumerate(texts)))


def test_corpus(corpus, texts):
    check(corpus, list(texts.items()))


def test_odd_rows(make_docs):
    line = "a line that everybody has"
    docs = [(i, f"start {i * i} and {'x' * i}\n{line}\nend {'y' * i} z{i}") for i in range(8)]
    docs += [(None, None), (20, ""), (20, "\n\n"), (21, line + "\n" + "word " * 40_000), (None, f"q\n{line}\nr"), docs[0]]
    df = make_docs([t for _, t in docs], [i for i, _ in docs], kept="x", n_lines=3, _at=1)
    rows = check(df, docs)
    assert all(r["n_removed"] >= 1 for r in rows if r["text"] and line in r["text"])
    short = L.without_boilerplate(df)
    assert short.columns == df.columns and short.count() == len(docs)
    assert all(r["kept"] == "x" and r["n_chars"] == len(r["text"] or "") for r in short.collect())
    assert L.drop_boilerplate(make_docs([])).collect() == []
