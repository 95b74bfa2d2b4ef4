"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, map_arrow

#: A graph of at most so many edges (a quarter of a megabyte) is finished in one task.
LAST_EDGES = 16_384


def roots(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The least node of the component of each node."""
    up: dict[int, int] = {}
    for a, b in pairs:
        for x in (a, b):
            up.setdefault(x, x)
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
    for x in sorted(up):  # what a node hangs on is less, and so done before it
        up[x] = up[up[x]]
    return up


def _last_moves(edges: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = roots((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["from", "to"])

    return map_arrow(edges.coalesce(1), make, "from bigint, to bigint")


def components(edges: DataFrame, scratch: Scratch, name: str, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is some node of it.

    Each round every node moves to whichever of itself and its neighbours comes
    first, edges follow their ends and vanish when both ends meet. Rounds take
    turns between two orders: that of the ids, in which a star around its least
    node falls together at once, and one drawn anew (a hash), which removes a
    constant share of the nodes of any graph, sorted paths too. So rounds grow with
    the logarithm of the largest component. Minima are combined within map tasks,
    and ends move by sort-merge joins of written tables, which AQE splits at hubs.
    What is left below ``last_edges`` takes no more rounds: one task ends it.
    """
    current = scratch.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    place, turn, left = None, 0, current.count()
    while left or place is None:
        last = left <= last_edges
        if last:
            moves = _last_moves(current)
        else:
            both = current.union(current.select("b", "a")).union(current.select("a", "a")).union(current.select("b", "b"))
            first = F.min_by("b", F.struct(F.xxhash64(F.col("b"), F.lit(turn)), F.col("b"))) if turn % 2 else F.min("b")
            moves = both.groupBy("a").agg(first.alias("to")).select(F.col("a").alias("from"), "to")
        moves = scratch.cut(moves, f"{name}-moves")
        if place is None:  # every node of the edges has moved, or stayed
            placed = moves.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            placed = scratch.cut(place.join(moves, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")), f"{name}-nodes")
        old = [current, *([] if place is None or turn == 1 else [place])]
        if last:
            left = 0
        else:
            moved = current.join(moves, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
            moved = moved.join(moves, F.col("b") == F.col("from")).select("a", F.col("to").alias("b")).where("a <> b")
            current = scratch.cut(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
            left = current.count()
        scratch.drop(*old, *([moves] if place is not None else []))
        place, turn = placed, turn + 1
    return place
