"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

The trees learn from a bounded sample of labelled rows (`most` rows, those with the smallest hashes of their ids);
the labels, ids, language and source never enter the statistics. Scoring is one pass over the whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import boosting

THRESHOLD = 0.3
MOST_LABELLED = 20_000

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": b" \t",
    "newline": b"\r\n",
    "stop": b".,;:?'\"",
    "shout": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~<>+=_\\/{}[]()",
    "high": range(128, 256),
}
_MEMBER = np.array([[b in chars for chars in map(bytes, _CLASSES.values())] for b in range(256)], float)


def text_statistics(texts) -> np.ndarray:
    """A row of statistics per text; a null text counts as empty, and every ratio of an empty text is 0."""
    rows, histograms = [], np.zeros((len(texts), 256))
    for i, text in enumerate(texts):
        text = text or ""
        raw = text.encode("utf-8", "replace")
        histograms[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = text.split()
        n = len(words)
        lengths = np.fromiter(map(len, words), float, n)
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        sizes = np.array([len(x) for x in lines], float)
        rows.append(
            (
                np.log1p(len(raw)),
                np.log1p(n),
                lengths.mean() if n else 0,
                lengths.std() if n else 0,
                lengths.max() if n else 0,
                len(counts) / n if n else 0,
                max(counts.values()) / n if n else 0,
                sum(a == b for a, b in zip(words, words[1:])) / n if n else 0,
                len(set(zip(words, words[1:]))) / n if n else 0,
                sum(w[:1].isupper() for w in words) / n if n else 0,
                sum(w.isupper() for w in words) / n if n else 0,
                sum(not w[-1].isalpha() for w in words) / n if n else 0,
                sum(not any(map(str.isalnum, w)) for w in words) / n if n else 0,
                np.log1p(len(lines)),
                sizes.mean() if len(lines) else 0,
                sizes.std() if len(lines) else 0,
                len(set(lines)) / len(lines) if lines else 0,
                n / len(lines) if lines else 0,
            )
        )
    total = np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    share = histograms / total
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1, keepdims=True)
    return np.hstack([np.array(rows, float).reshape(len(texts), 18), share @ _MEMBER, entropy])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> boosting.Trees:
    """Fits on at most `most` labelled documents outside fold 0. Null and unknown labels are left out; of an id's
    several labels or texts any one counts. Without labels every score is 0.5."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )

    def statistics(batches):
        for batch in batches:
            x = text_statistics(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["_label"], "x": list(x)})

    sample = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most `most` rows of an id and a label
        .mapInPandas(statistics, "doc_id long, label int, x array<double>")
        .orderBy("doc_id")
        .limit(2 * most)
        .toPandas()
        .drop_duplicates("doc_id")
    )
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), 29)
    return boosting.fit(x, sample["label"].to_numpy(float))


def scorer(model: boosting.Trees):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(text_statistics(texts.tolist())))

    return score


def score_quality(docs: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 if the score reaches the threshold), row by row. Null and empty
    texts get a score too; clashing columns of these names are replaced."""
    scored = docs.withColumn("score", scorer(model)("text"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
