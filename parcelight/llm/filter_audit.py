"""Filter interaction audit: what five filters remove in every order in which they can be applied.

Filters don't change a document, so a step is told by what was applied before it, as a set, and the filter that comes
next: 80 edges of the lattice of subsets. A document counts at an edge by the filters that it fails. Rows are counted by
part and failed filters first (at most 32 x 4 rows a part), these counts contribute to the edges, and the 600 steps of
the 120 orders are joined to the edges that they walk along.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .names import unused

FILTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that judge a text by itself; it must not be null."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct.cast("long") < 50 * n.cast("long"), "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def bits(failures: dict[str, Column]) -> Column:
    """Failed filters as a mask, A the lowest bit."""
    return sum((F.when(failed, 1 << FILTERS.index(name)).otherwise(0) for name, failed in failures.items()), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good and toxic of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), bits(text_failures(text)).alias("own"), F.unhex(F.sha2(text, 256)).alias("content"))
    facts = materialize(rows, "facts")
    ids = facts.groupBy("content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("content", "least")
    told = facts.join(materialize(ids, "repeated"), "content", "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    masks = told.select("doc_id", "part", (F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
    each = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = masks.join(materialize(each, "judgements"), "doc_id", "left")
    return known.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def lattice_edges() -> list[tuple[int, int]]:
    """(filters applied before, next filter), both as masks."""
    n = len(FILTERS)
    return [(sum(1 << k for k in before), 1 << f) for f in range(n) for size in range(n) for before in combinations([k for k in range(n) if k != f], size)]


def edge_counts(rows: DataFrame) -> DataFrame:
    """part, before, filter and the counts at that edge, zeros included, from part, mask, good and toxic."""
    kinds = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    edges = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in lattice_edges()])
    at = kinds.withColumn("edge", F.explode(edges)).select("part", "mask", "good", "toxic", "n", "edge.*")
    fails = F.col("mask").bitwiseAND(F.col("filter")) > 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) > 0
    removed = fails & ~earlier
    met = {"kept": ~fails & ~earlier, "removed": removed, "redundant": fails & earlier, "unique_fails": F.col("mask") == F.col("filter"), "good_lost": removed & F.col("good"), "toxic_lost": removed & F.col("toxic")}
    return at.groupBy("part", "before", "filter").agg(*[F.sum(F.when(met[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS])


def lattice_paths(spark: SparkSession) -> DataFrame:
    """filter_order, step, before, filter: a row per step of each order."""
    rows = []
    for order in permutations(FILTERS):
        masks = [1 << FILTERS.index(f) for f in order]
        rows += [("".join(order), step + 1, sum(masks[:step]), masks[step]) for step in range(len(order))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of documents within the part: 600 rows for every value of `source`.

    Null sources are the part of the empty string, null texts are empty (no words: they fail A alone, and E where another
    text is empty too). A row fails E if a smaller doc_id has the same text anywhere in the table: rows of one doc_id don't
    count against each other, and a null doc_id is neither smaller nor larger than any. A document without a label is
    neither good nor toxic; of repeated labels one that says 1 is enough. Words are parted by spaces and the control
    characters 9 to 13. An empty table gives no rows.
    """
    edges = edge_counts(judged(docs, labels))
    # Whichever order: a filter takes its place after a given set in |set|! (4 - |set|)! of them.
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("before") + 1)
    edges = materialize(edges, "edges")
    shares = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    steps = edges.join(F.broadcast(lattice_paths(docs.sparkSession)), ["before", "filter"])  # 600 rows at any size
    return steps.join(shares, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def passing(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The rows of docs that pass the named filters, with the columns of docs."""
    content, least, plain = unused(docs, "_content", "_least", "_plain")
    failures = text_failures(F.col(plain))
    kept = docs.withColumn(plain, F.coalesce(F.col("text"), F.lit(""))).filter(bits({f: failures[f] for f in filters if f != "E"}) == 0)
    if "E" not in filters:
        return kept.drop(plain)
    hashed = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    first = docs.groupBy(hashed.alias(content)).agg(F.min("doc_id").alias(least))
    joined = kept.withColumn(content, hashed).join(materialize(first, "first"), content)
    return joined.filter(F.coalesce(F.col("doc_id") <= F.col(least), F.lit(True))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
