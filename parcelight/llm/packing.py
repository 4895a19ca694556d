"""Best-fit packing by minimum bin slack.

Documents become token ids, long ones are cut, and the pieces fill sequences of a fixed capacity. Only the histogram
of piece lengths (at most `capacity` numbers) reaches the driver. There, bin by bin, the longest length left opens a
bin and a bitset subset-sum over the available lengths finds the fullest combination for the rest; a combination is
used as often as its lengths last. The resulting plan says which ranks of each length go to which sequence and offset,
and Spark joins it to the pieces, ranked within their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from .batches import small_batches
from .ranking import gapless_rank

CAPACITY = 1024
END_ID = 2
#: Parts of a length in which ranks are counted: at least so many, and more beyond so many pieces a part.
LEAST_PARTS, RANKED_ROWS = 64, 20_000
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level BPE file, if its ids follow the order of its merges; else None."""
    spec = json.loads(Path(path).read_text())
    vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    added, alphabet = {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
    first = len(vocab.keys() - added) - len(merges)
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or first != 256 or any(vocab.get(a + b) != first + i for i, (a, b) in enumerate(merges)):
        return None
    return {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items() if t not in added}


class Encoder:
    """Ids of whole texts as unsigned 32-bit numbers, those of the tokenizer file. The merging itself runs in tiktoken,
    which is several times faster; texts that name a special token, those that it refuses (very long runs of white space)
    and files that it can't express go to tokenizers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks := merge_ranks(path):
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # its splitting expression ran out of backtracking stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer one all but the first are full."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int).

    A null or empty text is the end id alone. Texts of any length are encoded whole. Repeated rows give repeated pieces. Columns besides doc_id and text are
    not read.
    """
    path = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END_ID], "<u4")
        for batch in small_batches(batches):
            columns: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.concatenate([encoder.ids(text or ""), end])
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    row = (doc_id, k, start, length, zlib.crc32(own.tobytes()), own.astype("i4"))
                    for column, value in zip(columns, row):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES + ", ids array<int>" * keep_ids)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with how often) from counts whose sum is the largest that fits into room."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first_rank, end_rank, sequence, each, offset): ranks first_rank up to end_rank of a length go, `each` to
    a sequence, to sequence, sequence + 1 ... from offset on."""
    counts = {n: c for n, c in histogram.items() if c}
    taken, plan, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(counts[n] // k for n, k in used.items()), 0
        for length, each in sorted(used.items(), reverse=True):
            plan.append((length, taken[length], taken[length] + times * each, sequence, each, offset))
            offset += length * each
            taken[length] += times * each
            counts[length] -= times * each
            if not counts[length]:
                del counts[length]
        sequence += times
    return plan


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, rows: int = RANKED_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (which is read twice: pass a stored table).

    The plan has a few rows per length, whatever the number of pieces, so it can be broadcast. Ranks within a length are
    counted in parts of about `rows` pieces, as many as the commonest length needs. No pieces: no rows.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    spread = max(LEAST_PARTS, -(-max(histogram.values(), default=0) // rows))
    plan = spark.createDataFrame(
        plan_bins(histogram, capacity) or [(0, 0, 0, 0, 1, 0)],
        "length long, first_rank long, end_rank long, first_sequence long, each long, first_offset long",
    )
    ranked = gapless_rank(pieces, ["length"], F.struct("doc_id", "piece"), ["doc_id", "piece", "ids_crc32"], "rank", spread)
    at = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(plan), "length")
        .filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - first_rank) div each"))
        .withColumn("offset", F.col("first_offset") + (at % F.col("each")) * F.col("length"))
        .drop("rank", "first_rank", "end_rank", "first_sequence", "each", "first_offset")
    )


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, materialize(token_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
