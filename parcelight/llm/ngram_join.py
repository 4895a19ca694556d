"""N-gram Jaccard join: all pairs of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from chosen-path splitting. A set is represented by 64 min-hash values; at a node of a path tree a
coordinate is chosen, and the node's sets split by their shared token there, its minimum. Nodes of few sets are compared
by brute force on two-bit sketches of all 64 values; larger ones split again. Sixteen runs, each with paths of its own,
bring the chance to miss a pair of similarity 0.8 below 1 in 10,000 even where all nodes split three times.

The pairs found group the sets; within every group all pairs are then compared exactly, so a link that no path found is
still counted if both ends are in one group. Equal sets are one class from the start. Large groups are cut into blocks
and compared block by block, in separate tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, table
from . import recompression as R
from .batches import small_batches
from .names import unused

SHINGLE, RUNS, DEPTH, VALUES = 5, 16, 6, 64
#: Similarity 0.8 as integers: 9 |a and b| >= 4 (|a| + |b|).
LIKENESS = (9, 4)
#: Sketches of pairs at 0.8 agree in 85 % of their values; four standard deviations less go on.
LEAST_AGREEING = 42
BRUTE, NODE, BLOCK, BLOCK_SHINGLES = 256, 20_000, 1000, 4_000_000
#: The chance to miss a pair of similarity 0.8 that needs no further runs, and the depth up to which a round is below it.
MISS, SHALLOW = 0.001, 3
#: Elements of a task's temporary arrays.
CHUNK = 500_000

_rng = np.random.default_rng(20_240_613)
_FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A path for each first coordinate, so that there are VALUES / RUNS rounds.
_PATHS = np.array([[r, *_rng.choice([c for c in range(VALUES) if c != r], DEPTH - 1, replace=False)] for r in range(VALUES)])


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, text by text, and where each text's begin. A text of fewer words, but not none,
    has all its words as its one shingle."""
    words = R.words_of(texts)
    counts = np.diff(words.first)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), n)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    shingles = R.range_hashes(words.one, start, start + np.minimum(counts, SHINGLE)[text], 0)
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])])[: len(text)]
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(texts) + 1))


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, _hash, n (shingles), one and two (a hash of the set), values (64 minima), low and high (their two lowest
    bits): a row per document."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = np.uint64
        for batch in small_batches(batches):
            shingles, first = shingle_sets(batch["text"].to_pylist())
            n = np.diff(first)
            some, minima = np.flatnonzero(n), np.zeros((len(n), VALUES), np.uint32)
            one, two, low, high = (np.zeros(len(n), u) for _ in range(4))
            if len(some):
                at = first[some]
                one[some] = np.add.reduceat(R.mix(shingles), at)
                two[some] = np.add.reduceat(R.mix(shingles + u(0x5851F42D4C957F2D)), at)
                for j, factor in enumerate(_FACTORS):
                    minima[some, j] = np.minimum.reduceat((shingles * factor) >> u(32), at)
            for j in range(VALUES):
                low |= (minima[:, j] & 1).astype(u) << u(j)
                high |= (minima[:, j] >> 1 & 1).astype(u) << u(j)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * VALUES), pa.array(minima.view(np.int32).ravel()))
            columns = [batch["doc_id"], batch["_hash"], pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat, pa.array(low.view(np.int64)), pa.array(high.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_hash", "n", "one", "two", "values", "low", "high"])

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_hash"))
    return keyed.mapInArrow(sketches, "doc_id long, _hash long, n long, one long, two long, values array<int>, low long, high long")


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut so that the rows of a key never part."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key]
        change = np.flatnonzero(keys.to_numpy(zero_copy_only=False) != keys[-1].as_py())
        if not len(change):
            if rest and rest[-1][key][-1] != keys[0]:
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            rest.append(batch)
            continue
        cut = int(change[-1]) + 1
        yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def runs_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)


def leaves(rows: np.ndarray, depth: int, path: np.ndarray, brute: int) -> Iterator[tuple[np.ndarray, int]]:
    """The leaves below a node, each with its depth."""
    if len(rows) <= brute or depth >= DEPTH:
        yield rows, depth
        return
    order = rows[np.argsort(path[rows, depth], kind="stable")]
    bounds = runs_of(path[order, depth])
    for a, b in zip(bounds, bounds[1:]):
        yield from leaves(order[a:b], depth + 1, path, brute)


def connect(rows: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows with like sketches that connect all rows of a leaf which are so alike."""
    while len(rows) > 1:
        queue, rows = [rows[0]], rows[1:]
        while queue and len(rows):
            q = queue.pop()
            agree = 64 - np.bitwise_count((low[rows] ^ low[q]) | (high[rows] ^ high[q])).astype(int)
            like = (agree >= LEAST_AGREEING) & (5 * n[rows] >= 4 * n[q]) & (4 * n[rows] <= 5 * n[q])
            for r in rows[like]:
                yield q, r
            queue.extend(rows[like])
            rows = rows[~like]


def run_paths(sets: DataFrame, first: int, node_rows: int, brute: int) -> DataFrame:
    """One round: the runs from number `first` on. Pairs (a, b) of set numbers with depth 0, and a row (a, a, depth) for
    each run that took a set deeper than SHALLOW."""
    steps = lambda r: F.array(*[F.get("values", F.lit(int(c))) for c in _PATHS[r]])
    runs = F.array(*[F.struct(F.xxhash64(F.lit(r), F.get("values", F.lit(int(_PATHS[r][0])))).alias("node"), steps(r).alias("path")) for r in range(first, first + RUNS)])
    rows = sets.select("cls", F.col("n").cast("int").alias("n"), "low", "high", F.explode(runs).alias("_r")).select("cls", "n", "low", "high", "_r.*")
    rows = rows.withColumn("depth", F.lit(1))
    for depth in range(1, DEPTH + 1):
        crowded = rows.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") > node_rows)
        if not crowded.head(1):
            break
        joined = rows.join(materialize(crowded, "nodes"), "node", "left")
        split = F.col("_n").isNotNull() & (F.col("depth") == depth)
        if depth < DEPTH:
            child = F.xxhash64("node", F.get("path", F.lit(depth)))
            rows = joined.withColumns({"node": F.when(split, child).otherwise(F.col("node")), "depth": F.when(split, depth + 1).otherwise(F.col("depth"))}).drop("_n")
        else:
            # No token is left to split by: every pair of parts is a node, so that all pairs meet. Only a part's own node
            # counts as a run; the others go by a depth beyond the last.
            parts = F.when(split, F.ceil(2 * F.col("_n") / node_rows)).otherwise(1).cast("int")
            part = F.pmod(F.xxhash64("cls"), parts).cast("int")
            met = joined.select("*", part.alias("_p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_o"))
            met = met.withColumn("node", F.when(split, F.xxhash64("node", F.least("_p", "_o"), F.greatest("_p", "_o"))).otherwise(F.col("node")))
            rows = met.withColumn("depth", F.when(F.col("_p") != F.col("_o"), DEPTH + 1).otherwise(F.col("depth"))).drop("_n", "_p", "_o")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "node"):
            node, cls, depth = (batch[c].to_numpy() for c in ("node", "cls", "depth"))
            n, low, high = batch["n"].to_numpy().astype(int), batch["low"].to_numpy().view(np.uint64), batch["high"].to_numpy().view(np.uint64)
            path = batch["path"].flatten().to_numpy().reshape(-1, DEPTH)
            bounds = runs_of(node)
            reached, found = np.where(brute > 0, depth, DEPTH), []
            for a, b in zip(bounds, bounds[1:]):
                for leaf, at in leaves(np.arange(a, b), int(depth[a]), path, brute) if b - a > 1 else ():
                    reached[leaf] = at
                    found.extend(connect(leaf, n, low, high))
            pair, deep = np.array(found, np.int64).reshape(-1, 2), np.flatnonzero((reached > SHALLOW) & (reached <= DEPTH))
            columns = [[cls[pair[:, 0]], cls[deep]], [cls[pair[:, 1]], cls[deep]], [np.zeros(len(pair), np.int32), reached[deep].astype(np.int32)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["a", "b", "depth"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(link, "a long, b long, depth int")


def chance_to_miss(runs_at: dict[int, Column]) -> Column:
    """The chance that all runs part a pair of similarity 0.8, given the number of runs that reached each depth. The runs
    share the 64 values, so it is the mean over how many of these differ (a binomial number)."""
    differ = range(VALUES - DEPTH)
    parted = lambda depth, d: math.log1p(-math.comb(VALUES - d, depth) / math.comb(VALUES, depth)) if d else -1e9
    weight = lambda d: math.comb(VALUES, d) * 0.2**d * 0.8 ** (VALUES - d)
    cases = [F.array(F.lit(weight(d)), *[F.lit(parted(depth, d)) for depth in runs_at]) for d in differ]
    log = lambda case: sum(case[i] * k for i, k in enumerate(runs_at.values(), 1))
    return F.aggregate(F.array(*cases), F.lit(0.0), lambda total, case: total + case[0] * F.exp(log(case)))


def candidate_edges(sets: DataFrame, node_rows: int = NODE, brute: int = BRUTE, miss: float = MISS) -> DataFrame:
    """Pairs (a, b) of set numbers, from as many rounds of runs as bring every set's chance to miss a partner of similarity
    0.8, judged by how deep its own runs went, below `miss`, or all. Nodes of up to `brute` sets don't split; with 0 all do
    to the end of their path."""
    deeper = range(SHALLOW + 1, DEPTH + 1)
    edges, left = None, sets.filter("n > 0").withColumns({f"at_{d}": F.lit(0) for d in deeper})
    for first in range(0, VALUES, RUNS):
        found = materialize(run_paths(left, first, node_rows, brute), "pairs")
        pairs = found.filter("depth = 0").select("a", "b")
        edges = pairs if edges is None else edges.union(pairs)
        deep = found.filter("depth > 0").groupBy(F.col("a").alias("cls")).agg(*[F.count_if(F.col("depth") == d).alias(f"more_{d}") for d in deeper])
        left = left.join(deep, "cls").withColumns({f"at_{d}": F.col(f"at_{d}") + F.col(f"more_{d}") for d in deeper})
        runs_at = {d: F.col(f"at_{d}").cast("double") for d in deeper}
        runs_at[SHALLOW] = F.greatest(first + RUNS - sum(runs_at.values()), F.lit(0.0))
        left = left.filter(chance_to_miss(runs_at) > miss).drop(*[f"more_{d}" for d in deeper])
        if first + RUNS == VALUES:
            break
        left = materialize(left, "deep_sets")
        if not left.head(1):
            break
    return edges.distinct()


def likenesses(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers of common shingles of all pairs of sets: products of columns for frequent shingles, counted pairs for
    the rare ones."""
    m = len(first) - 1
    member = np.repeat(np.arange(m), np.diff(first))
    _, token, df = np.unique(shingles, return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    dense = df > max(m // 16, 1) if m > 64 else df > 1
    number = np.cumsum(dense) - 1
    use = dense[token]
    rows, columns = member[use], number[token[use]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    wide = max(1, CHUNK // m) if m else 1
    for a in range(0, int(dense.sum()), wide):
        lo, hi = np.searchsorted(columns, [a, a + wide])
        x = np.zeros((m, wide), np.float32)
        x[rows[lo:hi], columns[lo:hi] - a] = 1
        common += x @ x.T
    rare = ~dense & (df > 1)
    use = rare[token]
    rows, tokens = member[use], token[use]
    order = np.lexsort((rows, tokens))
    rows, size = rows[order], df[tokens[order]]
    for d in np.unique(size):
        each = rows[size == d].reshape(-1, d)
        i, j = np.triu_indices(d, 1)
        step = max(1, CHUNK // len(i))
        for a in range(0, len(each), step):
            part = each[a : a + step]
            seen, times = np.unique(part[:, i].ravel() * m + part[:, j].ravel(), return_counts=True)
            common[seen // m, seen % m] += times
            common[seen % m, seen // m] += times
    return common


def exact_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """cls, links (documents linked to it in this comparison) and root (the least cls it is connected to in it), from
    members (doc_id, _hash, cls, copies, component, n): every pair of sets of a component is compared once."""
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    text = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text", F.xxhash64("text").alias("_of"))
    # A merge join at every size: the members grow with the corpus, and so does the broadcast that small inputs would get.
    with_text = dealt.hint("merge").join(text, (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.col("_hash") == F.col("_of"))).dropDuplicates(["cls"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")
    each = with_text.select("cls", "copies", "block", "blocks", "component", "text", other)
    # A pair of blocks is a group; a block alone compares its own pairs.
    group = F.xxhash64("component", F.least("block", "_o"), F.greatest("block", "_o"))
    rows = each.select("cls", "copies", "block", (F.col("block") == F.col("_o")).alias("own"), "text", group.alias("group"), "component")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, "group"):
            bounds = runs_of(batch["group"].to_numpy())
            out: list[np.ndarray] = []
            for a, b in zip(bounds, bounds[1:]):
                part = batch.slice(a, b - a)
                cls, copies, block = (part[c].to_numpy() for c in ("cls", "copies", "block"))
                own = part["own"][0].as_py()
                shingles, first = shingle_sets(part["text"].to_pylist())
                like = alike(likenesses(shingles, first), np.diff(first), block, own)
                links = np.array([copies[row].sum() for row in like])
                out.append(np.stack([cls, links, cls[roots(like, cls)]], axis=1))
            table = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k].astype(np.int64)) for k in range(3)], ["cls", "links", "root"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "cls long, links long, root long")


def alike(common: np.ndarray, n: np.ndarray, block: np.ndarray, own: bool) -> np.ndarray:
    """Which pairs are linked: in a block's own group all, in a group of two blocks those across (none if one is empty)."""
    like = np.zeros(common.shape, bool)
    for i, row in enumerate(common):
        like[i] = LIKENESS[0] * row >= LIKENESS[1] * (n[i] + n)
        like[i, i] = False
        if not own:
            like[i] &= block != block[i]
    return like


def roots(like: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """For each row the row of the least cls in its connected component."""
    found, left = np.full(len(cls), -1), np.argsort(cls, kind="stable")
    for seed in left:
        if found[seed] >= 0:
            continue
        found[seed], queue = seed, [seed]
        while queue:
            new = np.flatnonzero(like[queue.pop()] & (found < 0))
            found[new] = seed
            queue.extend(new)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, _hash, n_shingles, class_id, n_links, n_copies and first: a row per row of docs.

    class_id is the smallest doc_id among the documents that links connect to this one, n_links the number of other rows
    of docs whose shingles are this alike (n_copies of them have equal sets), first whether this row's set is that of the
    class's smallest doc_id. A text without words is like nothing: its class is its own. Texts of one to four words are
    alike if equal in words. Rows of one doc_id are documents of their own; null ids are larger than others. An empty
    table gives no rows.
    """
    sketches = materialize(sketch_table(docs), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_hash"))
    some = sketches.filter("n > 0")
    classes = materialize(some.groupBy("one", "two", "n").agg(least.alias("f"), F.count("*").alias("copies")), "classes")
    first = (F.col("doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("_hash") == F.col("f._hash"))
    sets = some.join(classes, ["one", "two", "n"]).filter(first).dropDuplicates(["one", "two", "n"])
    sets = materialize(sets.drop("f").withColumn("cls", F.monotonically_increasing_id()), "sets")
    grouped = materialize(connected_components(materialize(candidate_edges(sets), "edges")), "groups")
    members = materialize(sets.select("doc_id", "_hash", "cls", "copies", "n").join(grouped.withColumnRenamed("node", "cls"), "cls"), "members")
    links = materialize(exact_links(docs, members), "links")
    joined = connected_components(links.select("cls", "root")).withColumnRenamed("node", "cls")
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    ends = joined.join(sets.select("cls", F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")).alias("e")), "cls")
    tops = ends.groupBy("component").agg(F.min("e").alias("top"))
    known = ends.join(tops, "component").join(counted, "cls").select("cls", F.col("top.d").alias("class_id"), (F.col("e") == F.col("top")).alias("is_top"), "links")
    by_set = sets.select("one", "two", "n", "cls", F.col("doc_id").alias("rep"), "copies").join(known, "cls", "left")
    by_set = materialize(by_set.select("one", "two", "n", "copies", F.coalesce("is_top", F.lit(True)).alias("first"), F.when(F.col("is_top").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")), "by_set")
    found = sketches.select("doc_id", "_hash", "one", "two", "n").join(by_set, ["one", "two", "n"], "left")
    alone = F.col("n") == 0
    return found.select(
        "doc_id",
        "_hash",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
        F.when(alone, F.lit(True)).otherwise(F.col("first") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when one of each class does, that of the smallest doc_id; texts without words all stay.
    Of rows with one id and text one stays."""
    found = materialize(near_duplicates(docs.select("doc_id", "text")), "near").filter("first")
    alone = found.filter("n_shingles = 0").select("doc_id", "_hash").distinct().withColumn("_times", F.lit(1).cast("long"))
    rows = found.filter("n_shingles > 0").groupBy("class_id", "doc_id", "_hash").agg(F.count("*").alias("_times"))
    stays = rows.groupBy("class_id").agg(F.min(F.struct("_hash", "doc_id", "_times")).alias("s")).select("s.doc_id", "s._hash", "s._times").union(alone)
    doc, of, times = names = unused(docs, "_id", "_of", "_times")
    stays = materialize(stays.withColumnsRenamed({"doc_id": doc, "_hash": of, "_times": times}), "stays")
    joined = docs.join(stays, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(of)))
    once = joined.filter(F.col(times) == 1).drop(*names)
    if not stays.filter(F.col(times) > 1).head(1):
        return once
    return once.union(joined.filter(F.col(times) > 1).drop(*names).dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")
