"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

#: Edges that are contracted at a time; blocks of more than four times as many are cut.
CHUNK = 1 << 18


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges between nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        one, other = label[a], label[b]
        new = label.copy()
        np.minimum.at(new, one, other)
        np.minimum.at(new, other, one)
        while not np.array_equal(nearer := new[new], new):
            new = nearer
        if np.array_equal(new, label):
            return label
        label = new


def contracted(edges: pa.Table, cut: bool) -> pa.RecordBatch:
    """(node, component, cut) of some edges taken alone."""
    both = pa.chunked_array([*edges["x"].chunks, *edges["y"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[both.indices.to_numpy()]
    nodes = both.dictionary.take(order)
    label = least_labels(code[: edges.num_rows], code[edges.num_rows :], len(nodes))
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label)), pa.array(np.full(len(nodes), cut))], names=["node", "component", "cut"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts edges that come sorted by block, whole blocks at a time; `cut` marks what is of a block too large for that."""
    held, n, cut = [], 0, False
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK or not batch.num_rows:
            continue
        rows = pa.Table.from_batches(held)
        end = pc.index(rows["block"], rows["block"][-1]).as_py()  # the last block may go on
        if end:
            yield contracted(rows.slice(0, end), cut)
            held, n, cut = rows.slice(end).to_batches(), rows.num_rows - end, False
        elif n >= 4 * CHUNK:
            yield contracted(rows, True)
            held, n, cut = [], 0, True
    if n:
        yield contracted(pa.Table.from_batches(held), cut)


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation: hangs the neighbours of a node (all larger ones, or itself and all smaller ones) on the least
    node of its neighbourhood. Edges are (a, b) with a < b."""
    if small:
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if small:
        hung = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    else:
        hung = moved.filter(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def components_by_block(pairs: DataFrame, block: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """(node, component) from one shuffle of the edges (x, y) by block, and whether that is all: no edge leads from block to
    block, and none was too large."""
    kind = pairs.schema["x"].dataType.simpleString()
    near = pairs.repartition(block(F.col("x"))).sortWithinPartitions(block(F.col("x"))).select("x", "y", block(F.col("x")).alias("block"))
    found = near.mapInArrow(lambda batches: _blocks(batches), f"node {kind}, component {kind}, cut boolean")
    told, open_ = Observation(), F.col("cut") | ~block(F.col("node")).eqNullSafe(block(F.col("component")))
    stored = materialize(found.observe(told, F.count_if(open_).alias("n")), "components")
    return stored.select("node", "component"), told.get["n"] == 0


def connected_components(edges: DataFrame, most_rounds: int = 50, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node, component): the component being its least node, for every node of edges, whose first two columns may have
    any one comparable type. Loops and repeated edges are fine, null ends are left out.

    Alternates large and small stars, which takes a number of rounds logarithmic in the components' sizes. A round is one
    job: its edges are stored in the shared folder, and while they are written two numbers are taken of them, which tell
    the driver whether anything has changed.

    `block` gives a node's block, where edges (almost) never leave one: blocks are then contracted whole after a single
    shuffle, and rounds only follow where an edge does lead to another block, or for blocks too large for a task.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if block is not None:
        found, done = components_by_block(pairs, block)
        if done:
            return found
        pairs = found.select(F.col("component").alias("x"), F.col("node").alias("y"))
    first = materialize(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    now = first.filter("a <> b")
    seen = None
    for _ in range(most_rounds):
        told = Observation()
        both = _stars(_stars(now, small=False), small=True)
        now = materialize(both.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        if (state := told.get) == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return nodes.join(now.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
