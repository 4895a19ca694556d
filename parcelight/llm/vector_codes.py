"""Vector code compression: product quantisation with codebooks trained by Heap Lloyd.

A vector is cut into 16 parts; each part's position has a codebook, and a vector's code names the nearest entry of each.
Training passes over the table once a round. Along with a row's entries goes the slack of each: the distance to the next
best entry minus that to its own. An entry that moves by m can use up m, and another one that moves by up to M can use up
M, of the slack of every part assigned to it, so each entry has a cumulative drift. A task puts the parts of its rows into
a heap per entry, keyed by slack, and pops only those that the drift may have used up; they are rescanned exactly against
the whole codebook and take the drift at which they came in. All other parts keep their entries, which are proven nearest
without a look at the vector.

Codebooks (at most 64 entries a part) and drifts are all that the driver holds. A round's result is written to the shared
folder, rows and the sums of each task together, and is the next round's input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose heaps exist at a time.
ROWS = 8192
#: Integer components stay below this, so that squared distances fit in 64 bits.
LIMIT = 1 << 26
#: Below this, distances are exact in double precision.
EXACT = 1 << 23


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), exactly."""
    floor = np.floor(values.astype(np.float64) * SCALE)
    if len(floor) and np.abs(floor).max() >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // SCALE} in magnitude")
    return floor.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < EXACT / np.sqrt(x.shape[1]):
        x, entries = x.astype(np.float64), entries.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index), and a slack that is never above the true one."""
    d = distances(x, entries)
    code = d.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(d[at, code].astype(np.float64))
    if len(entries) == 1:
        return code, np.full(len(x), np.inf)
    rest = np.array(d, np.float64)
    rest[at, code] = np.inf
    lower = np.sqrt(rest.min(1))
    return code, np.maximum(lower - upper - 1e-9 * (1 + upper), 0)


def below(key: np.ndarray) -> np.ndarray:
    """Keys as 32-bit numbers that are not above them."""
    return np.nextafter(key.astype(np.float32), np.float32(-1)).clip(0)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry, its own move and the largest of the others'."""
    move = np.sqrt(((old - new) ** 2).sum(2, dtype=np.float64)) * (1 + 1e-9)
    other = np.zeros_like(move)
    for k in range(move.shape[1]):
        other[:, k] = np.delete(move, k, axis=1).max(axis=1, initial=0)
    return move + other


def violated(codes: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The rows whose slack an entry's drift may have used up, popped from a heap per entry. A heap's items are the key's
    bits, which are ordered as keys from 0 on are, above the row's number."""
    items = keys.view(np.uint32).astype(np.int64) << 32 | np.arange(len(keys))
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(drift) + 1))
    limit = np.nextafter(drift.astype(np.float32), np.float32(np.inf)).view(np.uint32).astype(np.int64)
    popped: list[int] = []
    for entry in np.flatnonzero(np.diff(ends)):
        heap = items[order[ends[entry] : ends[entry + 1]]].tolist()
        heapify(heap)
        most = int(limit[entry])
        while heap and heap[0] >> 32 <= most:
            popped.append(heappop(heap) & 0xFFFFFFFF)
    return np.array(popped, np.int64)


@dataclass(frozen=True)
class Books:
    """Codebooks (part, entry, component) and how far each entry has drifted since training began."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, new: np.ndarray) -> Books:
        return Books(new, self.drift + drifts(self.entries, new))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assigned(x: np.ndarray, books: Books, codes: np.ndarray | None, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and keys of the vectors x (row, part, component), and how many parts were scanned. Without codes all are."""
    n, scanned = len(x), 0
    codes = np.zeros((n, PARTS), np.uint8) if codes is None else codes.copy()
    first = keys is None
    keys = np.zeros((n, PARTS), np.float32) if first else keys.copy()
    for part in range(PARTS):
        rows = np.arange(n) if first else violated(codes[:, part], np.ascontiguousarray(keys[:, part]), books.drift[part])
        code, slack = scan(x[rows, part], books.entries[part]) if len(rows) else (np.zeros(0, int), np.zeros(0))
        codes[rows, part] = code
        keys[rows, part] = below(slack + books.drift[part][code])
        scanned += len(rows)
    return codes, keys, scanned


def part_sums(x: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, components and count)."""
    total = np.zeros((PARTS, entries, x.shape[2] + 1), np.int64)
    for part in range(PARTS):
        np.add.at(total[part], codes[:, part], np.concatenate([x[:, part], np.ones((len(x), 1), np.int64)], axis=1))
    return total


def binary(values: np.ndarray) -> pa.Array:
    """A cell of bytes per row."""
    raw, n = np.ascontiguousarray(values), len(values)
    size = raw.nbytes // n if n else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(raw)])


def cells(column: pa.Array, kind: type) -> np.ndarray:
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1) if rows else np.zeros((0, PARTS), kind)


def components(column: pa.Array, length: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != length).any():
        raise ValueError(f"vectors must have one length, here {length}")
    return scaled(column.flatten().to_numpy(zero_copy_only=False))


def stored(fields: list[T.StructField]) -> T.StructType:
    """What a round writes: the carried columns, and of a row its vector, codes and keys, or of a task its sums."""
    more = [T.StructField(n, T.BinaryType()) for n in ("_vector", "_codes", "_keys", "_sums")]
    return T.StructType([*fields, *more, T.StructField("_scanned", T.LongType())])


def rounds_kernel(books: Books, carried: list[str], width: int) -> Callable:
    """One pass: rows with new codes and keys, then a row with the task's sums."""
    shape, k = (-1, PARTS, width), books.entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scanned, none = np.zeros((PARTS, k, width + 1), np.int64), 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                first = "_vector" not in batch.schema.names
                x = (components(batch["_raw"], PARTS * width) if first else cells(batch["_vector"], np.int32).astype(np.int64)).reshape(shape)
                codes, keys, n = assigned(x, books, None, None) if first else assigned(x, books, cells(batch["_codes"], np.uint8), cells(batch["_keys"], np.float32))
                total += part_sums(x, codes, k)
                scanned += n
                nulls = [pa.nulls(len(x), pa.binary()), pa.nulls(len(x), pa.int64())]
                own = [batch[c] for c in carried]
                none = [(c.type, f) for c, f in zip(own, carried)]
                yield pa.RecordBatch.from_arrays([*own, binary(x.astype(np.int32)), binary(codes), binary(keys), *nulls], [*carried, "_vector", "_codes", "_keys", "_sums", "_scanned"])
        if none:
            cell = [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t, _ in none], *cell, pa.array([total.tobytes()], pa.binary()), pa.array([scanned])], [*carried, "_vector", "_codes", "_keys", "_sums", "_scanned"])

    return run


def final_kernel(books: Books, carried: list[str], width: int) -> Callable:
    """The last assignment: code, error and the number of parts scanned for the row's batch (at its first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = cells(batch["_vector"], np.int32).astype(np.int64).reshape(-1, PARTS, width)
                codes, _, n = assigned(x, books, cells(batch["_codes"], np.uint8), cells(batch["_keys"], np.float32))
                error = sum(((x[:, p] - books.entries[p][codes[:, p]]) ** 2).sum(1) for p in range(PARTS))
                scanned = np.zeros(len(x), np.int64)
                scanned[:1] = n
                text = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], text, pa.array(error, pa.int64()), pa.array(scanned)], [*carried, "code", "error", "_scanned"])

    return run


def add_up(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, entry and sums from the tasks' sums."""
    for batch in batches:
        for cell in batch["_sums"].to_pylist():
            total = np.frombuffer(cell, np.int64).reshape(PARTS, -1, width + 1)
            p, e = np.nonzero(total[:, :, width])
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "sums"])


def moved_books(books: Books, stored_rows: DataFrame, width: int) -> Books:
    """Entries at their parts' means, rounded down; at most 1,024 rows of sums reach the driver."""
    rows = stored_rows.filter("_sums is not null").select("_sums")
    each = rows.mapInArrow(partial(add_up, width), "part int, entry int, sums array<long>")
    summed = each.groupBy("part", "entry").agg(*[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width + 1)])
    new = books.entries.copy()
    for r in summed.collect():
        new[r["part"], r["entry"]] = [r[f"s{j}"] // r[f"s{width}"] for j in range(width)]
    return books.moved(new)


def first_books(kept: DataFrame) -> Books | None:
    """The parts of the vectors with the 64 smallest ids."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "_raw").limit(ENTRIES).select("_raw").collect()
    if not rows:
        return None
    width = len(rows[0][0])
    if width % PARTS or any(len(r[0]) != width for r in rows):
        raise ValueError(f"vectors must have one length, a multiple of {PARTS}")
    entries = scaled(np.array([r[0] for r in rows])).reshape(len(rows), PARTS, width // PARTS).swapaxes(0, 1)
    return Books(np.ascontiguousarray(entries), np.zeros((PARTS, len(rows))))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Books | None, list[int]]:
    """vec_id, label, code (two hex digits a part), error and label_error; the codebooks (None of an empty table); and how
    many parts each pass scanned.

    Rows whose vector is null, empty or holds null or non-finite components are dropped. Ids may repeat and be null (then
    they are larger than others); repeated rows are rows of their own, and where ids tie the smaller vector comes first. Of
    fewer than 64 rows the codebooks have as many entries. Vectors of different lengths, lengths that 16 doesn't divide and
    components of 2**18 and more are errors. Columns besides vec_id, embedding and label don't matter. An empty table gives no
    rows.
    """
    carried = ["vec_id", "label"]
    kept = vectors.filter(finite(F.col("embedding"))).select(*carried, F.col("embedding").alias("_raw"))
    books = first_books(kept)
    if books is None:
        empty = vectors.select(*carried, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.limit(0), None, []
    width, fields, scans = books.entries.shape[2], [kept.schema[c] for c in carried], []
    state = kept
    for r in range(rounds):
        fields_out = stored([T.StructField(f.name, f.dataType) for f in fields])
        done = materialize(state.mapInArrow(rounds_kernel(books, carried, width), fields_out), f"codes{r}")
        scans.append(done.agg(F.sum("_scanned")).head()[0])
        books = moved_books(books, done, width)
        state = done.filter("_sums is null").select(*carried, "_vector", "_codes", "_keys")
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("_scanned", T.LongType())])
    coded = materialize(state.mapInArrow(final_kernel(books, carried, width), schema), "coded")
    scans.append(coded.agg(F.sum("_scanned")).head()[0])
    totals = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    told = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return told.select("vec_id", "label", "code", "error", "label_error"), books, scans


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books, _ = compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else "")
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
