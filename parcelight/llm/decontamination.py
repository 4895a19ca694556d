"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or all words of a shorter one. Patterns of one
length share a shift table over blocks of two words: how far the search may move on when a text block ends at the
current position. Where the shift is 0, the block's bucket lists the patterns that end in it, by a hash of their words,
and a direct comparison of all words confirms an occurrence.

Items are one array of word numbers, and patterns places in it, so a task needs some 40 bytes a word of the benchmark and
the vocabulary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import recompression as R
from .names import unused

WINDOW = 13
#: Characters of items that a task holds at a time.
BLOCK_CHARS = 16 << 20
#: Words of lower-cased text: runs of ASCII digits, small letters and all characters beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Search:
    """The patterns of one length of at least two words: windows of the items (first word, end and number in `words`)."""

    def __init__(self, words: np.ndarray, items: np.ndarray, length: int):
        self.length, self.words = length, words
        first, end, number = items.T
        size = end - first
        item = np.repeat(np.arange(len(items)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # the word's place in its item
        place = first[item] + at
        inner = at > 0
        block = self.blocks(words[place[inner] - 1], words[place[inner]])
        shift = np.maximum(length - 1 - at[inner], 0)  # how far the pattern of the earliest end is from ending here
        order = np.lexsort((shift, block))
        self.block, new = np.unique(block[order], return_index=True)
        self.shift = shift[order][new].astype(np.uint8 if length < 256 else np.int32)
        last = at >= length - 1
        stop, owner = place[last] + 1, number[item[last]]
        code, key = self.blocks(words[stop - 2], words[stop - 1]), self.hashes(words, stop - length, stop)
        order = np.lexsort((key, code))
        self.code, self.key, self.stop, self.owner = code[order], key[order], stop[order].astype(np.int32), owner[order].astype(np.int32)

    @staticmethod
    def blocks(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(np.int64) << 32 | two

    @staticmethod
    def hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return R.range_hashes(R.mix(words.astype(np.uint64) + np.uint64(1)), start, stop, 0)

    def bucket(self, code: int, key: np.uint64) -> slice:
        """The patterns that end in the block and have the hash."""
        a, b = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        return slice(a + np.searchsorted(self.key[a:b], key, "left"), a + np.searchsorted(self.key[a:b], key, "right"))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items' numbers) of the patterns in ids; words that no item has are -1."""
        n = self.length
        if len(ids) < n or not len(self.block):
            return
        code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), self.blocks(ids[:-1], ids[1:]), -1)
        near = np.minimum(np.searchsorted(self.block, code), len(self.block) - 1)
        steps = np.concatenate([[0], np.where(self.block[near] == code, self.shift[near], n - 1)])
        at, keys = n - 1, None
        while at < len(ids):
            step = int(steps[at])
            if not step:
                if keys is None:
                    ends = np.arange(n, len(ids) + 1)
                    keys = self.hashes(ids, ends - n, ends)
                own = self.bucket(int(code[at - 1]), keys[at - n + 1])
                windows = self.words[self.stop[own][:, None] - np.arange(n, 0, -1)]
                same = (windows == ids[at - n + 1 : at + 1]).all(axis=1)
                if same.any():
                    yield at - n + 1, self.owner[own][same]
                step = 1
            at += step


class Benchmark:
    """The windows of (item, text) pairs, grouped by length."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.items, self.number = [item for item, _ in items], {}
        ids, by_length, at = [], {}, 0
        for k, (_, text) in enumerate(items):
            own = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if own:
                ids.append(np.array(own, np.int32))
                by_length.setdefault(min(window, len(own)), []).append((at, at + len(own), k))
                at += len(own)
        words = np.concatenate([np.zeros(0, np.int32), *ids])
        self.single: dict[int, list[int]] = {}
        for first, _, k in by_length.pop(1, ()):
            self.single.setdefault(int(words[first]), []).append(k)
        self.searches = [Search(words, np.array(rows, np.int64), n) for n, rows in sorted(by_length.items())]

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Sorted, joined intervals of hit words, and the items that occur."""
        ids, spans, found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words)), [], set()
        if self.single:
            for i, w in enumerate(ids.tolist()):
                if w in self.single:
                    spans.append((i, i + 1))
                    found.update(self.single[w])
        for s in self.searches:
            for start, owners in s.occurrences(ids):
                spans.append((start, start + s.length))
                found.update(owners.tolist())
        return join_spans(spans), {self.items[k] for k in found}


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark's items in blocks of a bounded size, each small enough for every task to hold; nothing is
    collected yet. One block unless the texts exceed block_chars; null items and texts have no windows."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = max(1, -(-total // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(part == k) for k in range(n)]


def search(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, out: str = "_found") -> DataFrame:
    """docs with `out`, a struct of the number of words, the joined intervals of hit words and the items' ids.

    A map over the documents for each block of the benchmark: no shuffle, rows stay as they are. Each further block is a
    pass of its own over the stored result of the one before, so that driver and tasks hold one block at a time.
    """
    found = docs.withColumn(out, F.lit(None).cast("struct<n:long,spans:array<array<int>>,items:array<string>>"))
    for k, block in enumerate(item_blocks(benchmark, block_chars)):
        found = materialize(found, "spans") if k else found
        found = found.withColumn(out, searcher([(r["item_id"], r["text"]) for r in block.collect()])("text", out))
    return found


def verdict(n_hit, n_words):
    """Contaminated: any hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def n_hit(found: str):
    return F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, n_hit, hit_spans (joined word intervals), item_ids (sorted as strings) and contaminated;
    columns of docs with these names are replaced.

    A null text has no words; an empty benchmark hits nothing; repeated items count once per item_id; repeated rows of
    docs are judged each on their own.
    """
    (name,) = unused(docs, "_found")
    found, of = search(docs, benchmark, block_chars, name), F.col(name)
    values = {"n_words": of["n"], "n_hit": n_hit(name), "hit_spans": of["spans"], "item_ids": of["items"], "contaminated": verdict(n_hit(name), of["n"])}
    return found.withColumns(values).drop(name)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    (name,) = unused(docs, "_found")
    return search(docs, benchmark, out=name).filter(~verdict(n_hit(name), F.col(name)["n"])).drop(name)


def searcher(items: list[tuple[int, str]]):
    made: list[Benchmark] = []

    @F.pandas_udf("n long, spans array<array<int>>, items array<string>")
    def find(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(Benchmark(items))
        rows = []
        for text, spans, seen in zip(texts, before["spans"], before["items"]):
            words = words_of(text)
            new, hit = made[0].hits(words)
            if spans is not None:
                new = join_spans([*new, *((int(a), int(b)) for a, b in spans)])
                hit = {*map(str, hit), *seen}
            rows.append((len(words), new, sorted(map(str, hit))))
        return pd.DataFrame(rows, columns=["n", "spans", "items"])

    return find.asNondeterministic()  # so that Spark keeps it where it is, and runs it once, when a filter follows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
