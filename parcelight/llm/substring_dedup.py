"""Substring dedup by recompression: removes words that lie in a window of 50 words which a smaller doc_id also has.

1. Recompression rounds name the runs and pairs of every text (recompression.py). Every window chooses one symbol that
   lies well inside it; windows in a row that choose one symbol form a block. Equal windows choose equal symbols.
2. A table of (symbol, content of the block, document). A block that a smaller document has goes as a whole. A symbol
   with several different blocks may hide windows that are equal although their blocks aren't.
3. For these, the smallest document with each distinct block hashes the block's windows; a window that a smaller
   document also has goes.

Copies therefore cost a row per block, not per window, and a block that a third of the documents share is counted with
partial aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import recompression as R
from .batches import small_batches
from .names import unused

WINDOW = 50
#: Words as in the contract: runs of anything but space and the control characters 9 to 13.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_COUNT_BITS = 24  # of a block's windows, which are fewer than words of a window


def texts_with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and _hash, which tells apart the rows of one id."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"))


def block_table(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, _hash, anchor, content, at: a row per block, `at` holding its first window (a word's number) and count."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = R.words_of(batch["text"].to_pylist())
            found = R.window_blocks(words, window)
            text = words.text[found.first]
            at = (found.first - words.first[text]) << _COUNT_BITS | found.count
            columns = [batch["doc_id"].take(pa.array(text)), batch["_hash"].take(pa.array(text)), *(pa.array(x.view(np.int64)) for x in (found.anchor, found.content)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_hash", "anchor", "content", "at"])

    keyed = texts_with_key(docs.filter("doc_id is not null and text is not null"))
    return keyed.mapInArrow(blocks, "doc_id long, _hash long, anchor long, content long, at long")


def telling_blocks(blocks: DataFrame) -> DataFrame:
    """anchor, content, least (the smallest doc_id with the block), mixed (its symbol has other blocks too): those blocks
    that several documents have or whose symbol is mixed."""
    distinct = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", F.lit(True).alias("mixed"))
    found = distinct.join(mixed, "anchor", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    return found.filter("mixed or least < most").select("anchor", "content", "least", "mixed")


def per_document(blocks: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, _hash, gone and unsure: blocks that go, and blocks whose windows are to be compared."""
    joined = blocks.join(telling, ["anchor", "content"])
    gone = F.when(F.col("doc_id") > F.col("least"), F.col("at"))
    unsure = F.when(F.col("mixed") & (F.col("doc_id") == F.col("least")), F.col("at"))
    kept = joined.select("doc_id", "_hash", gone.alias("gone"), unsure.alias("unsure")).filter("gone is not null or unsure is not null")
    return kept.groupBy("doc_id", "_hash").agg(F.collect_list("gone").alias("gone"), F.collect_list("unsure").alias("unsure"))


def spread(at: np.ndarray) -> np.ndarray:
    """The windows of blocks."""
    first, count = at >> _COUNT_BITS, at & ((1 << _COUNT_BITS) - 1)
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(at) else at


def unsure_windows(docs: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """one, two (hashes of a window's words), doc_id, _hash, start."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            words = R.words_of(batch["text"].to_pylist())
            own = [spread(np.array(at, np.int64)) for at in batch["unsure"].to_pylist()]
            text = np.repeat(np.arange(len(own)), [len(x) for x in own])
            start = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)
            first = start + words.first[text]
            pair = [R.range_hashes(v, first, first + window, k) for k, v in enumerate((words.one, words.two))]
            columns = [*(pa.array(x.view(np.int64)) for x in pair), batch["doc_id"].take(pa.array(text)), batch["_hash"].take(pa.array(text)), pa.array(start)]
            yield pa.RecordBatch.from_arrays(columns, ["one", "two", "doc_id", "_hash", "start"])

    wanted = known.filter(F.size("unsure") > 0).select("doc_id", "_hash", "unsure")
    return texts_with_key(docs).join(wanted, ["doc_id", "_hash"]).mapInArrow(hashed, "one long, two long, doc_id long, _hash long, start long")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, _hash, gone (blocks) and starts (windows): where windows begin that a smaller doc_id has too."""
    blocks = materialize(block_table(docs, window), "blocks")
    telling = materialize(telling_blocks(blocks), "telling")
    known = materialize(per_document(blocks, telling), "known")
    windows = materialize(unsure_windows(docs, known, window), "windows")
    shared = windows.groupBy("one", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("one", "two", "least")
    shared = materialize(shared, "shared")
    later = windows.join(shared, ["one", "two"]).filter("doc_id > least").groupBy("doc_id", "_hash").agg(F.collect_list("start").alias("starts"))
    later = materialize(later, "later")  # so that the windows' shuffle is gone when the texts are joined
    return known.select("doc_id", "_hash", "gone").join(later, ["doc_id", "_hash"], "full")


def remover(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept string")
    def remove(texts, gone, starts):
        import pandas as pd

        rows = []
        for text, blocks, begins in zip(texts, gone, starts):
            words = WORD.findall(text or "")
            covered = np.zeros(len(words) + 1, np.int64)
            for at in (spread(np.array(blocks, np.int64)) if blocks is not None else (), begins if begins is not None else ()):
                if len(at):
                    np.add.at(covered, np.asarray(at, np.int64), 1)
                    np.add.at(covered, np.asarray(at, np.int64) + window, -1)
            keep = np.cumsum(covered)[:-1] == 0
            rows.append((len(words), int((~keep).sum()), " ".join(w for w, k in zip(words, keep) if k)))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by one space); columns of docs with these names are
    replaced.

    A null text has no words. Windows are judged on the input: a word goes if a window over it also starts in a smaller
    doc_id. Rows of one doc_id don't count against each other, and a null doc_id is neither smaller nor larger than any,
    so such rows stay whole. Texts of fewer words than the window stay whole. An empty table gives no rows. A window must be
    long enough for a symbol between its margins (33 words).
    """
    if window < R.SHORTEST:
        raise ValueError(f"a window has {R.SHORTEST} words at least")
    doc, of, gone, starts, result = unused(docs, "_doc", "_of", "_gone", "_starts", "_done")
    found = repeated_windows(docs.select("doc_id", "text"), window).withColumnsRenamed({"doc_id": doc, "_hash": of, "gone": gone, "starts": starts})
    joined = docs.join(found, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(of)), "left")
    done = joined.withColumn(result, remover(window)("text", gone, starts))
    return done.withColumns({n: F.col(result)[n] for n in ("n_words", "n_removed", "kept")}).drop(doc, of, gone, starts, result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
