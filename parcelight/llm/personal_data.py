"""Personal data: base patterns, and boosted trees over further candidates.

The base kinds are fixed patterns with checks and are always kept. Beyond them, high-recall generators propose spans of
looser formats, which may overlap. Gradient-boosted trees score each candidate from its format and its context, a
threshold per kind, calibrated on held-out examples, decides, and of overlapping spans the likeliest stays. The trees
learn from generated examples (a fixed number, from a fixed seed): no text of the corpus is needed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import boosting
from .names import unused

#: Fixed values of the result's contract: the base kinds in their order.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGIT = re.compile(r"[0-9]")
#: The same matches in time linear in the text: repeats that never give back, and a start only where a run of the first
#: class begins. (A match of an email may also begin right after another; of an ip it can't, as the last run is whole.)
_LINEAR = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": BASE["phone"],
}
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def searched(kind: str, text: str) -> Iterator[re.Match]:
    """What BASE[kind].finditer(text) finds."""
    if kind != "email":
        yield from _LINEAR[kind].finditer(text)
        return
    at = 0
    while m := (at and _EMAIL_HERE.match(text, at)) or _LINEAR[kind].search(text, at):
        yield m
        at = m.end()


def passes(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == "card":
        digits = only_digits(found)
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(only_digits(found)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    has_digit = _DIGIT.search(text) is not None
    out = []
    for kind in BASE:
        if "@" in text if kind == "email" else has_digit and (kind != "phone" or "+" in text):
            out += [(kind, m.start(), m.end()) for m in searched(kind, text) if passes(kind, m[0])]
    return out


_H = "[0-9A-Fa-f]{1,4}"
_COMPRESSED = f"(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?"
_AT, _DOT = r"[(\[]\x20?(?i:at)\x20?[)\]]", r"[(\[]\x20?(?i:dot)\x20?[)\]]"
#: Generators of further candidates; kind, what a text must hold for a search to be worth while (None: a digit), pattern.
GENERATORS = (
    ("local_phone", None, re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[\x20./-]?[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,4}(?![\w-])")),
    ("national_id", re.compile("-[0-9]"), re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", None, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")),
    ("ipv6", re.compile(":"), re.compile(rf"(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?=:*[0-9A-Fa-f]){_COMPRESSED})(?![\w:])")),
    ("spelled_email", re.compile(_AT), re.compile(rf"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{{2,}}+\x20?{_AT}\x20?[A-Za-z0-9-]{{2,}}+(?:\x20?(?:{_DOT}|\.)\x20?[A-Za-z]{{2,10}})+")),
)
KINDS = [kind for kind, *_ in GENERATORS]
_HINTS = tuple(
    re.compile(p, re.I)
    for p in (
        r"\b(phone|tel|telephone|téléphone|telefon|teléfono|portable|móvil|mobil|handy|call|mobile|fax|whatsapp)\b",
        r"\b(ssn|social security|national id|tax id)\b",
        r"\b(iban|bank|account|transfer)\b",
        r"\b(e-?mail|contact|write to|reach)\b",
        r"\b(ip|host|address|server)\b",
        r"\b(version|order|invoice|ref|part|isbn|page|model|no|id|article|sku|build)\b",
    )
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    has_digit = _DIGIT.search(text) is not None
    return [
        (kind, m.start(), m.end())
        for kind, needed, pattern in GENERATORS
        if (needed.search(text) if needed else has_digit)
        for m in pattern.finditer(text)
        if kind != "local_phone" or 7 <= len(only_digits(m[0])) <= 13
    ]


def char_class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "\"'=:" else 4


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and its surroundings."""
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = only_digits(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)]
    compact = own.replace(" ", "")
    parts = own.split(":")
    mod97 = 0.0
    if kind == "iban":
        mod97 = float(int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1)
    return [
        *(float(kind == k) for k in KINDS),
        *(groups[k] if k < len(groups) else 0 for k in (1, 2)),
        float(own.lstrip("(").startswith("0")),
        len(own),
        len(digits),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        len(set(re.findall(r"[^A-Za-z0-9]", own))),
        float("(" in own),
        float("." in own),
        float("dot" in own.lower()),
        float(". " in own),
        len(parts) if kind == "ipv6" else 0,
        max(map(len, parts)) if kind == "ipv6" else 0,
        sum(len(p) == 2 for p in parts) if kind == "ipv6" else 0,
        float("::" in own),
        len(set(digits)),
        mod97,
        float(kind == "national_id" and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        char_class(text[start - 1 : start]),
        char_class(text[end : end + 1]),
        len(only_digits(before)),
        len(only_digits(after)),
        *(float(h.search(before) is not None) for h in _HINTS),
    ]


def _iban(rng: np.random.Generator, valid: bool) -> str:
    body = "".join(rng.choice(list("0123456789"), 18))
    number = int(body + str(int("D", 36)) + str(int("E", 36)) + "00")
    check = 98 - number % 97
    return f"DE{(check if valid else 1 + (check + rng.integers(1, 90)) % 97):02d}{body}"


def _ipv6(rng: np.random.Generator, right: bool) -> str:
    """Full and compressed addresses of varied prefixes; or clock times, hardware ids and qualified names."""
    group = lambda: f"{rng.integers(1, 65536):{rng.choice(['x', '04x', 'X'])}}"
    groups = lambda low, high: ":".join(group() for _ in range(rng.integers(low, high)))
    two = lambda k, form: ":".join(f"{rng.integers(100 if form == '02d' else 256):{form}}" for _ in range(k))
    if not right:
        word = lambda: str(rng.choice(["add", "bad", "face", "dead", "fade", "feed", "dec", "ace", "Cab", "Bed"]))
        forms = [lambda: f"{two(2, '02d')}::{two(1, '02d')}", lambda: two(8, "02x"), lambda: two(8, "02d"), lambda: f"::{word()}", lambda: f"{word()}::{word()}", lambda: f"{word()}::"]
        return forms[rng.integers(len(forms))]()
    head = rng.choice(["2001:db8", "2001:0db8", "2a00:1450", "2600:1f18", "2400:cb00", "fe80", "fd12:3456", "2003", group()])
    rest = 8 - len(head.split(":"))
    zeros = lambda: ":".join(rng.choice(["0", group()]) for _ in range(rest))
    padded = lambda: ":".join(rng.choice(["0000", f"{rng.integers(65536):04x}"]) for _ in range(rest))
    forms = [lambda: f"{head}:{groups(rest, rest + 1)}", lambda: f"{head}:{zeros()}", lambda: f"{head}:{padded()}", lambda: f"{head}::{groups(1, rest)}", lambda: f"{head}:{groups(1, rest - 1)}::{group()}", lambda: f"{head}:{groups(1, rest)}::", lambda: f"::{groups(2, 7)}"]
    return forms[rng.integers(len(forms))]()


def _phone(rng: np.random.Generator, right: bool) -> str:
    """Numbers as several countries write them; or dates, sizes and other groups of digits."""
    d = lambda k: "".join(rng.choice(list("0123456789"), k))
    n = lambda k: str(rng.integers(1, 10)) + d(k - 1)
    sep = str(rng.choice([" ", ".", "-"]))
    if right:
        forms = [
            lambda: f"({n(3)}) {n(3)}-{d(4)}",
            lambda: f"({n(3)}){n(3)}-{d(4)}",
            lambda: sep.join([n(3), n(3), d(4)]),
            lambda: sep.join(["0" + n(1), d(2), d(2), d(2), d(2)]),
            lambda: sep.join(["0" + n(2), n(4), d(4)]),
            lambda: sep.join(["0" + n(2), n(3), d(4)]),
            lambda: f"0{n(int(rng.integers(2, 5)))}{rng.choice(['/', ' ', '-'])}{n(3)}{rng.choice([' ', '-'])}{d(int(rng.integers(2, 5)))}",
            lambda: f"(0{n(int(rng.integers(2, 4)))}) {n(3)} {d(4)}",
            lambda: " ".join([rng.choice(["6", "7", "9"]) + d(2), d(2), d(2), d(2)]),
            lambda: " ".join([rng.choice(["6", "7", "9"]) + d(2), d(3), d(3)]),
        ]
    else:
        forms = [
            lambda: f"{rng.integers(1900, 2100)}{sep}{rng.integers(1, 13):02d}{sep}{rng.integers(1, 32):02d}",
            lambda: f"{rng.integers(1, 32):02d}{rng.choice(['.', '/', '-'])}{rng.integers(1, 13):02d}{rng.choice(['.', '/', '-'])}{rng.integers(1900, 2100)}",
            lambda: " ".join(["978", n(2), n(4), d(2)]),
            lambda: " ".join(n(2) for _ in range(rng.integers(4, 7))),
            lambda: " ".join(n(4) for _ in range(3)),
            lambda: f"{n(4)}-{d(3)}-{d(2)}",
            lambda: f"{n(2)} {n(3)}.{d(2)}",
            lambda: f"{rng.integers(1900, 2100)} {rng.integers(1900, 2100)} {n(3)}",
            lambda: ".".join([n(2), n(3), d(3)]),
            lambda: " ".join([rng.choice(["1", "2", "3"]) + d(2), "000", "000"]),
        ]
    return forms[rng.integers(len(forms))]()


def examples(n: int = 6000, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): spans in invented contexts, right ones and look-alikes."""
    rng = np.random.default_rng(seed)
    filler = ["the report says", "was noted on", "see also", "in the list of", "and then", "they wrote", "for", "we found"]
    hints = [
        ["phone:", "tel", "call me at", "mobile", "fax"],
        ["SSN", "social security number", "tax id"],
        ["IBAN", "bank account", "transfer to"],
        ["host", "server address", "ip"],
        ["mail", "contact", "write to"],
    ]
    against = ["version", "order", "invoice no", "part", "page", "model", "build", "isbn", "sku"]
    d = lambda k: "".join(rng.choice(list("0123456789"), k))
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(3, 9)))
    out = []
    for _ in range(n):
        k, right = int(rng.integers(len(KINDS))), bool(rng.integers(2))
        kind, cue = KINDS[k], ""
        if kind == "local_phone":
            own, cue = _phone(rng, right), rng.choice(["", *hints[0]]) if rng.integers(2) else ""
            if not right and rng.integers(2):  # a right form that something else is said to be
                own, cue = _phone(rng, True), rng.choice(against)
        elif kind == "national_id":
            own = f"{rng.choice([n for n in (rng.integers(1, 900), rng.integers(100, 600)) if n != 666]):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10_000):04d}"
            cue = rng.choice(["", *hints[1]])
            if not right:
                own, cue = (own, rng.choice(against)) if rng.integers(2) else (f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", rng.choice(["", *against, *hints[1]]))
        elif kind == "iban":
            own, cue = _iban(rng, right), rng.choice(["", *hints[2]])
        elif kind == "ipv6":
            own = _ipv6(rng, right)
            cue = rng.choice(["", *hints[3]]) if right else rng.choice(["", "at", *against])
        else:
            at, dot = (rng.choice([f"({w})", f"[{w}]", f"( {w} )"]) for w in [("at", "dot"), ("AT", "DOT"), ("At", "Dot")][rng.integers(3)])
            own = f"{word()}.{word()} {at} {word()} {dot} com" if right else f"{word()} {at} {word()}. {word()}"
            cue = rng.choice(hints[4]) if right else ""
        near = [word(), word().title(), f"{word().title()} {word().title()},", f"{word()} {d(int(rng.integers(1, 5)))}", f"{word()}, {own},", ""]
        start = [f"{rng.choice(filler)} ", f"{word()}\n", ""][rng.integers(3)]
        head = f"{start}{near[rng.integers(len(near))]} {cue}{rng.choice(['', ':', '.']) if cue else ''} ".lstrip(" ")
        tail = rng.choice([" ", ", ", ". ", "\n", "; "]) + rng.choice([*filler, own, ""])
        out.append((head + own + tail, kind, len(head), len(head) + len(own), int(right)))
    return out


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees
    thresholds: dict[str, float]


def calibrated(score: np.ndarray, label: np.ndarray, precision: float) -> float:
    """Of the thresholds with the asked precision the one of the most right spans; of equally good ones that a quarter of
    the way up, as a missed span costs more than a false one. 2, which selects nothing, if there is none."""
    grid = [float(t) for t in np.linspace(0.05, 0.95, 46) if (score >= t).any() and label[score >= t].mean() >= precision]
    found = [int(label[score >= t].sum()) for t in grid]
    best = [t for t, n in zip(grid, found) if n == max(found)]
    return best[len(best) // 4] if best else 2.0


@functools.cache
def train(n: int = 8000, precision: float = 0.98) -> Model:
    """Trees from two thirds of the examples; a threshold for each kind from the rest."""
    rows = examples(n)
    x = np.array([describe(t, kind, a, b) for t, kind, a, b, _ in rows])
    y, kinds = np.array([r[4] for r in rows], float), np.array([r[1] for r in rows])
    cut = 2 * len(rows) // 3
    trees = boosting.fit(x[:cut], y[:cut], trees=100, depth=4)
    score = trees.probability(x[cut:])
    own = {kind: kinds[cut:] == kind for kind in KINDS}
    return Model(trees, {kind: calibrated(score[m], y[cut:][m], precision) for kind, m in own.items()})


def joined_spans(spans) -> list[tuple[int, int]]:
    """Sorted, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def is_free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether a to b overlaps none of the sorted, disjoint spans."""
    k = bisect_left(taken, (b, b))
    return not k or taken[k - 1][1] <= a


def finder(model: Model):
    @F.pandas_udf("base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int>>")
    def find(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        base, proposed = [base_spans(t) for t in texts], [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
        more: list[list] = [[] for _ in texts]
        taken = [joined_spans((a, b) for _, a, b in spans) for spans in base]
        if proposed:
            score = model.trees.probability(np.array([describe(texts[i], *c) for i, c in proposed]))
            for s, (i, (kind, a, b)) in sorted(zip(score, proposed), key=lambda p: (-p[0], p[1])):
                if s >= model.thresholds[kind] and is_free(taken[i], a, b):
                    insort(taken[i], (a, b))
                    more[i].append((kind, a, b))
        order = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))]
        as_rows = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        return pd.DataFrame({"base": [as_rows(b) for b in base], "more": [order(m) for m in more]})

    return find


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with `base` and `more`: arrays of (kind, start, end), code points with the end exclusive, in the order of the
    kinds and then of the starts; columns of docs with these names are replaced.

    A map: no shuffle, repeated rows and ids are searched each on their own, a null text counts as empty, very long texts
    cost in proportion to their length, an empty table gives no rows.
    """
    (name,) = unused(docs, "_found")
    found = docs.withColumn(name, finder(model or train())("text"))
    return found.withColumns({"base": F.col(name)["base"], "more": F.col(name)["more"]}).drop(name)


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; the spans must not overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda x, s: F.struct(s["end"].alias("at"), F.concat(x["out"], F.substring(text, x["at"] + 1, s["start"] - x["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
    done = F.aggregate(ordered, start, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "more")).alias("spans"),
    )
