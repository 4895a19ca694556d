"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. The index holds, for every trigram that some query
names, the documents whose text has it. Rules' clauses are joined to the postings, a clause whose trigrams all meet in
a document makes it a candidate of the rule, and the expression itself then decides. Rules that require no trigram
(long hexadecimal runs) scan every text.

All of it is DataFrame expressions. Postings carry a hash of the doc_id: rows that share an id share candidates, which
costs a search in vain at most, never a finding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .names import unused
from .trigrams import query_of


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of pattern; those whose `group` is shorter than `least` are dropped. No match
    begins right after a character of the class `alone`, so that a run of them is tried once and not from each place."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    alone: str = ""


_NAMES = "password|passwd|secret|token|api_?key"
_ANY_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _NAMES)
#: Fixed values of the result's contract: the base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Public formats of credentials beyond the base.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", alone="A-Za-z0-9_-"),
    Rule("url_login", r"[a-z][a-z0-9+]*://[^\s/:@]+:[^\s/:@]{6,}@[A-Za-z0-9.-]+", alone="A-Za-z0-9+"),
)
RULES = BASE + MORE
#: A run of one character class: matches that are long enough are those of the bounded pattern, which skips the rest.
_BOUNDED = {"[0-9a-f]+": "[0-9a-f]{%d,}", "AKIA[A-Z0-9]+": "AKIA[A-Z0-9]{%d,}"}


def clause_rows(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, int]]:
    """(trigram, rule, clause, number of trigrams of the clause)."""
    rows = []
    for r, rule in enumerate(rules):
        for c, clause in enumerate(query_of(rule.pattern) or ()):
            rows += [(t, r, c, len(clause)) for t in sorted(clause)]
    return rows


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): a row per listed trigram and document that has it, upper and lower case alike."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains("_t", F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(doc_key().alias("key"), text.alias("_t")).select("key", F.explode(held).alias("trigram"))


def doc_key() -> Column:
    return F.xxhash64("doc_id")


def candidates(spark: SparkSession, postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): the rules, as bits, for which the document's postings satisfy a clause."""
    clauses = spark.createDataFrame(clause_rows(rules), "trigram string, rule int, clause int, needed int")
    met = (
        postings.distinct()
        .join(F.broadcast(clauses), "trigram")  # a few rows per rule
        .groupBy("key", "rule", "clause", "needed")
        .count()
        .filter(F.col("count") == F.col("needed"))
    )
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def matches(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the rule's matches in text, those too short left out.

    The pieces between the matches and the matches themselves give the positions.
    """
    pattern = _BOUNDED[rule.pattern] % (rule.least - 4 * rule.pattern.startswith("AKIA")) if rule.pattern in _BOUNDED else rule.pattern
    pattern = f"(?<![{rule.alone}]){pattern}" if rule.alone else pattern
    regex = F.lit(pattern)
    whole = F.transform(F.regexp_extract_all(text, regex, 0), lambda m: F.length(m))
    part = F.transform(F.regexp_extract_all(text, regex, rule.group), lambda m: F.length(m)) if rule.group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")), lambda x: x["whole"].isNotNull())
    found = F.filter(placed(steps), lambda s: s["part"] >= rule.least)
    found = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def placed(steps: Column) -> Column:
    """Array of (start, end, part) from (gap, whole, part): each match begins a gap after the one before ends.

    A fold copies what it has gathered at every step. So the steps are folded in blocks of about the root of their number,
    each from 0 on, and the blocks then moved to where the ones before end.
    """
    span = "array<struct<start:int,end:int,part:int>>"

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + x["whole"]
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part")))).alias("out"))

    def folded(block):
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")), step)

    def blocks(all_steps):
        size = F.greatest(F.ceil(F.sqrt(F.size(all_steps))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / size).cast("int")), lambda k: folded(F.slice(all_steps, k * size + 1, size)))

    def move(state, block):
        at = state["at"]
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["part"].alias("part")))
        return F.struct((at + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    once = F.element_at(F.transform(F.array(steps), blocks), 1)  # in a variable: the blocks read it again and again
    moved = F.aggregate(once, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")), move)["out"]
    return F.flatten(moved)


def scan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with `secrets`: array of (start, end, kind) by start, then the order of the rules.

    A null text counts as empty and has none. Repeated rows and ids are searched each on their own; other columns
    stay, but one named `secrets` is replaced. Very long texts cost in proportion to their length. An empty table gives
    no rows.
    """
    key, own_rules = unused(docs, "_key", "_rules")
    rows = clause_rows(rules)
    indexed = {r for _, r, _, _ in rows}
    wanted = candidates(spark, build_index(docs, sorted({t for t, *_ in rows})), rules)
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = docs.withColumn(key, doc_key()).join(wanted.select(F.col("key").alias(key), F.col("rules").alias(own_rules)), key, "left")
    text, spans = F.coalesce(F.col("text"), F.lit("")), []
    for r, rule in enumerate(rules):
        own = matches(text, rule)
        if r in indexed:
            own = F.when(F.coalesce(F.col(own_rules), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0, own).otherwise(none)
        spans.append(F.transform(own, with_rule(r)))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    found = F.transform(F.array_sort(F.concat(*spans)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["rule"]).alias("kind")))
    return joined.withColumn("secrets", found).drop(key, own_rules)


def with_rule(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("rule"), s["end"].alias("end"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"),
    )
