"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words with their counts. For sample k every term draws, from hashes of (term, k), two
Gamma(2, 1) numbers r and c and a uniform b; with weight w, t = floor(ln w / r + b) and the term's key is
ln a = ln c - r (t - b + 1). The term of the smallest key, with its t, is the sample. Two documents agree in a sample
with the probability of their generalised Jaccard similarity, so the share of equal samples estimates it.

All of it is DataFrame expressions: the words of a document are exploded, counted and reduced to `samples` minima within
the partition that holds the document, so the texts are shuffled once and nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, table

SAMPLES = 32
NULL_ID = -(1 << 63)
_LOW = 0xFFFFFFFF


def unit(bits: Column, width: int) -> Column:
    """A number in (0, 1) from the lowest bits."""
    return (bits.bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)


def sample_key(term: Column, log_weight: Column, k: int) -> Column:
    """The key's order in the upper half of a long, the identity of (term, t) in the lower half."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(unit(one, 32) * unit(F.shiftrightunsigned(one, 32), 32))
    c = -F.log(unit(two, 24) * unit(F.shiftrightunsigned(two, 24), 24))
    b = unit(F.shiftrightunsigned(two, 48), 16)
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b + 1)
    order = (F.least(F.greatest(log_a + 128, F.lit(0.0)), F.lit(255.0)) * float(1 << 23)).cast("long")
    return F.shiftleft(order, 32).bitwiseOR((term + t * 2654435761).bitwiseAND(F.lit(_LOW)))


def terms(text: Column) -> Column:
    """The words; a text without any has one null term."""
    return F.split(F.translate(text, "\t\n\r\f\x0b", "     "), " ")


def signatures(terms_of: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and `sig`, an array of longs (null where there is no term), from a row per occurrence of a term. Runs where
    terms_of is partitioned by one or more of the keys without a shuffle."""
    counted = terms_of.withColumn("_term", F.when(F.col("_word") != "", F.xxhash64("_word"))).groupBy(*keys, "_term").count()
    weight = F.log(F.col("count").cast("double"))
    minima = [F.min(sample_key(F.col("_term"), weight, k)).alias(f"_s{k}") for k in range(samples)]
    return counted.groupBy(*keys).agg(*minima).select(*keys, F.array(*[f"_s{k}" for k in range(samples)]).alias("sig"))


def shown(sig: Column) -> Column:
    """Eight hexadecimal digits per sample; of a text without words '-'."""
    low = F.transform(sig, lambda s: F.lpad(F.hex(s.bitwiseAND(F.lit(_LOW))), 8, "0"))
    return F.when(F.get(sig, F.lit(0)).isNull(), F.lit("-")).otherwise(F.lower(F.array_join(low, "")))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples; two texts without words are alike, one is like no other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e)) / F.size(a)
    return F.when(F.get(a, F.lit(0)).isNull() != F.get(b, F.lit(0)).isNull(), F.lit(0.0)).otherwise(same)


def id_bounds(docs: DataFrame, buckets: int) -> list[int]:
    """At most `buckets` ids of docs that cut them into ranges of about equal sizes, the largest id last."""
    at = [(i + 1) / buckets for i in range(buckets)]
    found = docs.agg(F.percentile_approx(sort_id(), at, F.lit(20 * buckets)).alias("b"), F.max(sort_id()).alias("m")).head()
    return sorted({*(found["b"] or ()), *([found["m"]] if found["m"] is not None else ())})


def sort_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def rank_below(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below value, by bisection."""
    held, top = F.array(*map(F.lit, bounds)), max(len(bounds).bit_length() - 1, 0)
    jumps = F.array(*[F.lit(1 << k) for k in range(top, -1, -1)])
    return F.aggregate(jumps, F.lit(0), lambda at, j: F.when((at + j <= len(bounds)) & (F.get(held, at + j - 1) < value), at + j).otherwise(at))


def with_next(docs: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """doc_id, text, next_text, bucket and row: each document beside the one after it in descending doc_id.

    Documents are dealt into id ranges, each with a copy of the document that comes after its last, marked `ghost`.
    Null ids come last; equal ids are in the order of their texts. Only the bounds of the ranges reach the driver.
    """
    bounds = id_bounds(docs, buckets) or [0]
    at = rank_below(F.col("_id"), bounds)
    is_bound = F.array_contains(F.array(*map(F.lit, bounds)), F.col("_id")) if len(bounds) < 3 else F.get(F.array(*map(F.lit, bounds)), F.col("_at")) == F.col("_id")
    place = lambda bucket, ghost: F.struct(bucket.cast("int").alias("bucket"), F.lit(ghost).alias("ghost"))
    places = F.array_compact(F.array(place(F.col("_at"), False), F.when(is_bound, place((F.col("_at") + 1) % len(bounds), True))))
    dealt = (
        docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), sort_id().alias("_id"))
        .withColumn("_at", at)
        .select("text", "_id", F.explode(places).alias("_place"))
        .select("text", "_id", "_place.*")
        .repartition(tasks, "bucket")
    )
    order = W.partitionBy("bucket").orderBy("ghost", F.desc("_id"), "text")
    doc_id = F.when(F.col("_id") != NULL_ID, F.col("_id")).alias("doc_id")
    return dealt.select(doc_id, "text", "bucket", "ghost", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text"))


def compare_with_edited(docs: DataFrame, samples: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document.

    A null text counts as empty; an empty table gives no rows; repeated rows follow one another; the next document of
    a single one is itself. Columns besides doc_id and text are not read. `buckets` is the number of id ranges (by
    default four for each shuffle partition), a range being what one task sorts, with spilling if need be.
    """
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("text")
    kept = F.left("text", n - F.expr("length(text) div 2").cast("int"))
    edited = F.concat(kept, F.left(F.coalesce(F.col("next_text"), F.lit("")), F.expr("length(text) div 2").cast("int")))
    # After the texts are dealt into buckets, everything stays within a bucket.
    paired = with_next(docs, min(buckets or 4 * tasks, 8192), tasks).withColumn("edited", edited)
    spot = lambda side: F.col("row") * 2 + side
    words = paired.select(
        "bucket", F.explode(F.array(F.struct(spot(0).alias("spot"), F.col("text").alias("body")), F.struct(F.when(~F.col("ghost"), spot(1)).alias("spot"), F.col("edited").alias("body")))).alias("_v")
    )
    words = words.filter(F.col("_v.spot").isNotNull()).select("bucket", F.col("_v.spot").alias("spot"), F.explode(terms(F.col("_v.body"))).alias("_word"))
    order = W.partitionBy("bucket").orderBy("spot")
    ahead = signatures(words, ["bucket", "spot"], samples).select(
        "bucket", "spot", "sig", F.lead("sig", 1).over(order).alias("edited_sig"), F.lead("sig", 2).over(order).alias("next_sig")
    )
    ahead = ahead.filter(F.col("spot") % 2 == 0).withColumn("row", F.expr("spot div 2").cast("int"))
    facts = paired.filter(~F.col("ghost")).select("bucket", "row", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    facts = materialize(facts, "facts")
    return facts.join(ahead, ["bucket", "row"]).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("sig")).alias("fingerprint"),
        shown(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))
