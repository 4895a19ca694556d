"""Exact dedup: documents whose texts are the same but for white space.

1. Texts are counted apart by (128-bit content hash, bytes): the aggregate compares bytes and combines equal texts in each
   task before the shuffle, so that a text crosses the network once per task, however many copies it has. A hash with
   more than one text is a collision.
2. Every row is stored with its hash and lengths, and with its text only where the hash collides.
3. Groups are counted from these narrow rows, and only groups of two rows or more are joined back to them, as a plain
   equi-join that Spark can split where a group is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .names import unused

#: What doesn't count when texts are compared.
BLANK = r"[\x20\x09-\x0D]+"


def content(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def content_hash(plain: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.md5(plain))


def colliding(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """_h: the hashes that stand for more than one text."""
    texts = docs.select(content(F.col("text")).alias("_plain")).select(hashed(F.col("_plain")).alias("_h"), "_plain").distinct()
    return texts.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")


def mark_copies(docs: DataFrame, carried: Sequence[str] | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The columns `carried` (all, if not given) of docs with keep_id, group_size, kept and text_sha256; columns of docs with
    these names are replaced.

    Equal texts are those with the same characters in the same order when white space is left out; a null text is empty,
    and all texts of white space are equal to it. Of a group that row is kept which has the most code points, then the
    smallest doc_id (nulls last); of repeated rows that tie in all of this exactly one. Every row comes back. An empty
    table gives no rows. `hashed` only leads texts together: whatever it is, texts of different bytes are never a group.
    """
    carried = list(docs.columns if carried is None else carried)
    h, plain, n, sha, tie, size, best, doc = unused(docs, "_h", "_plain", "_n", "_sha", "_tie", "_size", "_best", "_doc")
    mixed = materialize(colliding(docs, hashed), "collisions").withColumnRenamed("_h", h)
    new = {h: hashed(F.col(plain)), sha: F.unhex(F.sha2(F.col(plain), 256)), n: F.length(F.coalesce(F.col("text"), F.lit(""))), doc: F.col("doc_id")}
    rows = docs.withColumn(plain, content(F.col("text"))).withColumns(new).join(mixed.withColumn(size, F.lit(True)), h, "left")
    apart = F.when(F.col(size), F.col(plain)).otherwise("").alias(plain)
    facts = materialize(rows.select(*carried, h, apart, n, sha, doc, F.monotonically_increasing_id().alias(tie)), "facts")
    order = F.struct((-F.col(n)).alias("a"), F.col(doc).isNull().alias("b"), F.col(doc).alias("c"), F.col(tie).alias("d"))
    groups = facts.groupBy(h, plain).agg(F.count("*").alias(size), F.min(order).alias(best)).filter(F.col(size) > 1)
    joined = facts.join(materialize(groups, "groups"), [h, plain], "left")
    alone = F.col(size).isNull()
    found = {
        "keep_id": F.when(alone, F.col(doc)).otherwise(F.col(best)["c"]),
        "group_size": F.coalesce(F.col(size), F.lit(1)).cast("long"),
        "kept": alone | (F.col(best)["d"] == F.col(tie)),
        "text_sha256": F.lower(F.hex(sha)),
    }
    return joined.select(*[c for c in carried if c.lower() not in found], *[value.alias(name) for name, value in found.items()])


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    (stays,) = unused(docs, "_stays")
    renamed = {c: f"_{k}_{stays}" for k, c in enumerate(docs.columns) if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")}
    marked = mark_copies(docs.withColumnsRenamed(renamed)).filter("kept")
    return marked.drop("keep_id", "group_size", "kept", "text_sha256").withColumnsRenamed({v: k for k, v in renamed.items()}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
