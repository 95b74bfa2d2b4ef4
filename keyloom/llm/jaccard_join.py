"""N-gram Jaccard join: linked documents by pivots, Voronoi regions and triangle-inequality windows.

A document is the set of its distinct word shingles; two link when
``den * |intersection| >= num * |union|``. The result is the components of the
links, exactly. The join works in a metric space, from coarse to fine:

1. Cells. The shingles' hash space is divided between k evenly placed pivots,
   each owning its Voronoi cell. The size of the symmetric difference is a metric
   that lies between sizes a <= b of linked sets at most at D = (a + b)(den - num) /
   (den + num); so with k = D + 1 cells at least one cell holds the same shingles in
   both. Sizes are banded (a set is also entered in the band of every smaller
   partner, the triangle inequality around the empty set), and a set enters the
   region (band, cell, content of the cell). Cells of at most one shingle say little
   and would make large regions: with w cells more, a set may pass over up to w such
   weak cells, for more than w cells of a linked pair are the same in both, and so
   weak in both or in neither. Weak cells of a set that has more of them are divided
   again by a second, independent division.
2. Neighbourhoods. Sets that share a region are joined to its first member (a
   star, never all pairs); components of the stars are neighbourhoods. With ``Rule.sift``,
   regions of fewer than LOCAL rows join only those of their sets that can be linked by their
   signatures, so that a passage in common doesn't make neighbours. Every linked
   pair lies within one neighbourhood, and Jaccard distances within one are spread
   out, where those between unrelated documents are all 1.
3. Voronoi regions. A neighbourhood above REGION_SETS sets or REGION_SHINGLES
   shingles draws pivot documents, as many as its size asks for, and each set's
   Jaccard distance to each of them is taken. Sets within the threshold link to the
   pivot at once; a group that hangs together by such links needs no further look
   inside it (its main sets). Each core set, one whose links are still sought,
   belongs to its nearest pivot's region and, by distance, to one shell of it as thick
   as the threshold. By the triangle inequality its links lie in that shell and the two
   beside it, and no partner is farther from that pivot than from its own nearest one
   by more than two thresholds; so sets near a boundary are replicated to the shells
   they can reach, and to no others. The shells are regions again and join
   recursively, with new pivots, as long as that halves the pairs left to look at.
   A region that distance doesn't divide (all sets alike far from all, say documents
   that have one passage in common) is divided by its rarest shared shingles, which
   leaves out the sets that have too few shingles in common with any other. What
   neither divides is joined in blocks of core sets against blocks of all.
4. Each part is joined exactly by an inverted index in one task, which returns a
   spanning forest of its links; components of all forests are the result.

Equal sets are one class from the start, so copies cost nothing. Shingles are
64-bit hashes and classes 128-bit sums of them: a false link takes a collision of
64-bit hashes within a pair of documents. A word's hash is a sum of random values of
its bytes and places, so no text is made to collide by its form.

Scale: the text is read three times and moves only to fetch the sets of step 3; regions
are shuffled once, as pairs of integers that tasks combine before; hot regions, classes and pivots
are joined as written tables, which AQE splits. No task holds more than a region,
and no step lists the pairs of a group. Only regions that nothing divides copy
their sets in proportion to their size. Tables that no result reads are removed.

Defined results: null or word-free text is an empty set, linked with nothing, its
own component. Rows that repeat a doc_id are all returned and link like any
others. A null doc_id takes part; a component_id is null only if all ids of the
component are. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .components import components, roots
from .tables import Scratch, free_shuffles, map_arrow, read, ship

REGION_SETS, REGION_SHINGLES = 512, 2_000_000
#: A divided region draws four pivots for each REGION_SETS sets, and at most so many.
PIVOTS = 30
GROWTH = 1.4
#: Keys that a task combines at a time (48 MB), and rows of one key that it lets stand.
CHUNK_KEYS, LOCAL = 2_000_000, 32
#: Bits of a signature, and rows of small regions that one task sifts.
SIGNATURE_BITS, SIFTED_ROWS = 512, 50_000

U = np.uint64
_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x + U(int(salt) * _ODD & _ALL)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass(frozen=True)
class Rule:
    """What a shingle is and when two sets link."""

    words: int = 3
    num: int = 90
    den: int = 100
    #: Only for speed: how far a band reaches, and hundredths of the differing shingles by which cells are spared.
    growth: float = GROWTH
    spare: int = 2
    #: Also for speed: the regions are found in so many phases, each with its share of the keys on disk.
    phases: int = 1
    #: And whether pairs of small regions are sifted by signatures before they make neighbourhoods.
    sift: bool = False

    @property
    def threshold(self) -> float:
        """The Jaccard distance of linked sets at most."""
        return 1 - self.num / self.den

    def differ(self, largest: int) -> int:
        """The shingles by which linked sets may differ, of which the smaller has at most ``largest``."""
        both = largest + largest * self.den // self.num
        return both * (self.den - self.num) // (self.den + self.num)

    def cells(self, largest: int) -> tuple[int, int]:
        """(cells, spare ones among them) of the band whose smaller sets have at most ``largest`` shingles."""
        differ = self.differ(largest)
        spare = 1 + differ * self.spare // 100
        return differ + 1 + spare, spare

    def least_partner(self, size: int) -> int:
        return -(-size * self.num // self.den)


def _bands(most: int, growth: float = GROWTH) -> np.ndarray:
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * growth)))
    return np.array(bounds)


# A word's hash is the sum of a random value for each of its bytes and their places, mixed: nothing in it repeats
# from place to place, as the powers of a polynomial modulo 2^64 do.
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(U)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of the bytes, with A-Z lower-cased."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.zeros(len(raw), np.int64)
    begin[start] = start
    place = np.arange(len(raw)) - np.maximum.accumulate(begin)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(_mixed(_LOWER[raw] | place.astype(U) << U(8), 11), out=total[1:])
    return _mixed(total[end] - total[start] + (end - start).astype(U)), start


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, start = word_hashes(b" ".join(texts))
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(start, first_byte)
    full = max(len(hashes) - words + 1, 0)
    rolled = np.zeros(full, U)
    for k in range(words):
        rolled = _mixed(rolled + hashes[k : k + full], k + 1)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.zeros(1, U)
            for k in range(a, b):
                whole = _mixed(whole + hashes[k : k + 1], 1000 + k - a)
            out.append(whole)
        else:
            out.append(np.zeros(0, U))
    return out


def set_identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    return tuple(int(np.sum(_mixed(shingles, salt), dtype=U).view(np.int64)) for salt in (101, 102))


def signature(shingles: np.ndarray) -> bytes:
    """For each of SIGNATURE_BITS parts of the hash space whether the set has an odd number of shingles in it: sets
    whose signatures differ in some number of bits differ by that many shingles at least."""
    part = (_mixed(shingles, 801) >> U(64 - (SIGNATURE_BITS - 1).bit_length())).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=SIGNATURE_BITS) & 1).tobytes()


def _cell_contents(ordered: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum of mixed shingles, number of shingles) in each of the cells; ``ordered`` ascends."""
    edges = (np.arange(1, cells, dtype=object) * (1 << 64) // cells).astype(U)
    at = np.concatenate([[0], np.searchsorted(ordered, edges), [len(ordered)]])
    total = np.concatenate([[U(0)], np.cumsum(_mixed(ordered, 201), dtype=U)])
    return total[at[1:]] - total[at[:-1]], np.diff(at)


def region_keys(shingles: np.ndarray, rule: Rule, bands: np.ndarray) -> np.ndarray:
    """The regions that a set enters, as 64-bit keys."""
    n = len(shingles)
    if not n:
        return np.zeros(0, U)
    low, high = np.searchsorted(bands, [max(1, rule.least_partner(n)), n], "right") - 1
    keys, second = [], None
    for band in range(low, high + 1):
        largest = int(bands[band + 1]) - 1
        if not rule.differ(largest):  # only equal sets link here, and those are one class
            continue
        cells, spare = rule.cells(largest)
        content, count = _cell_contents(shingles, cells)
        here = _mixed(_mixed(content + count.astype(U), 301) + np.arange(cells, dtype=U), 401 + band)
        keys.append(here[count > 1])
        if (count <= 1).sum() > spare:
            if second is None:
                second = np.sort(_mixed(shingles, 501))
            content, others = _cell_contents(second, cells)
            again = _mixed(_mixed(content + others.astype(U), 302) + np.arange(cells, dtype=U), 402)
            keys.append(_mixed(here[count <= 1][:, None] + again[None, :], 601).ravel())
    return np.concatenate(keys) if keys else np.zeros(0, U)


def _slices(batch: pa.RecordBatch, column: int, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of about so many bytes of text, with the texts (null: empty)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most_bytes):
            size += sizes[end]
            end += 1
        part = batch.slice(at, end - at)
        yield part, [t or b"" for t in part.column(column).to_pylist()]
        at = end


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def features(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, c1, c2 (the class of equal sets) and the signature (null if the rule doesn't sift) per row (doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 1):
                sets = shingle_sets(texts, rule.words)
                classes = [set_identity(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in classes], pa.int64()), pa.array([c[1] for c in classes], pa.int64()), pa.array([signature(s) if rule.sift else None for s in sets], pa.binary())],
                    ["doc_id", "n", "c1", "c2", "signature"],
                )

    rows = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = rows.select("doc_id").schema.add("n", "long").add("c1", "long").add("c2", "long").add("signature", "binary")
    return map_arrow(rows, make, schema)


def _spread(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, node) rows that connect the same nodes, with at most LOCAL rows a key: the others of a
    larger group are each connected to its first node by a key of their own. Only those keys are odd."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    fresh = new_key | np.concatenate([[True], nodes[1:] != nodes[:-1]])
    keys, nodes, new_key = keys[fresh], nodes[fresh], new_key[fresh]
    start = np.flatnonzero(new_key)
    sizes = np.diff(np.append(start, len(keys)))
    first = np.repeat(nodes[start], sizes)
    beyond = np.arange(len(keys)) - np.repeat(start, sizes) >= LOCAL
    own = _mixed(keys[beyond] + _mixed(nodes[beyond], 701), 702) | U(1)
    return np.concatenate([keys[~beyond] & ~U(1), own, own]), np.concatenate([nodes[~beyond], first[beyond], nodes[beyond]])


def region_rows(docs: DataFrame, rule: Rule, phase: int = 0) -> DataFrame:
    """(key, node): the regions that each text's set enters; a node is the first half of the set's identity.

    Every key belongs to one of the rule's phases. Rows go straight into a shuffle and are written nowhere. Each task combines CHUNK_KEYS of
    them at a time, so a region of a third of all sets has a few rows a chunk.
    """

    def combined(keys: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        if any(map(len, keys)):
            found = _spread(np.concatenate(keys), np.repeat(np.array(nodes, np.int64).view(U), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["key", "node"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, keys, nodes, held = _bands(1 << 20, rule.growth), [], [], 0
        for batch in batches:
            for _, texts in _slices(batch, 0):
                for found in shingle_sets(texts, rule.words):
                    while len(found) >= bands[-2]:
                        bands = _bands(int(bands[-1]) * 4, rule.growth)
                    own = region_keys(found, rule, bands)
                    keys.append(own[own % U(rule.phases) == phase] if rule.phases > 1 else own)
                    nodes.append(set_identity(found)[0])
                    held += len(keys[-1])
                    if held >= CHUNK_KEYS:
                        yield from combined(keys, nodes)
                        keys, nodes, held = [], [], 0
        yield from combined(keys, nodes)

    return map_arrow(docs.select(F.col("text").cast("binary").alias("text")), make, "key bigint, node bigint")


def _sifted(rows: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of the rows (key, node, n, signature) of one key that can be linked.

    Sets link only if they differ by few shingles for their sizes; signatures say by how many they differ at least.
    Regions here have fewer than LOCAL rows, and a task looks at many of them at once.
    """

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, nodes, sizes = (table.column(c).to_numpy() for c in ("key", "node", "n"))
        bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), U).reshape(len(keys), -1)
        a, b = [], []
        for lag in range(1, LOCAL * 2):
            x = np.flatnonzero(keys[lag:] == keys[:-lag]) if lag < len(keys) else np.zeros(0, np.int64)
            if not len(x):
                break
            y = x + lag
            both = sizes[x] + sizes[y]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
            can = (differ * (rule.den + rule.num) <= both * (rule.den - rule.num)) & (rule.den * np.minimum(sizes[x], sizes[y]) >= rule.num * np.maximum(sizes[x], sizes[y])) & (nodes[x] != nodes[y])
            a.append(nodes[x[can]])
            b.append(nodes[y[can]])
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    ship(rows.sparkSession)
    parts = max(1, rows.count() // SIFTED_ROWS)
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(make, "a bigint, b bigint").distinct()


def _with_sets(rows: DataFrame, rule: Rule) -> DataFrame:
    """Rows (node, n, c1, c2, text) as (node, shingles), where the text has that class."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 4):
                nodes, kept = [], []
                wanted = zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)
                for (node, n, c1, c2), found in zip(wanted, shingle_sets(texts, rule.words), strict=True):
                    if (n, c1, c2) == (len(found), *set_identity(found)):
                        nodes.append(node)
                        kept.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(kept)], ["node", "shingles"])

    return map_arrow(rows, make, "node bigint, shingles array<bigint>")


def _column_sets(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).view(U)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def linked_forest(sets: list[np.ndarray], rule: Rule, group: np.ndarray | None = None, core: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of the core sets (default: of all), by an inverted index over their shingles.

    ``group``: sets of one group count as connected already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    posting, begin = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))
    first = np.cumsum(sizes) - sizes
    root = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    forest = []
    for x in range(len(sets)) if core is None else np.flatnonzero(core):
        if (root == root[x]).all():
            continue
        mine = shingle[first[x] : first[x] + sizes[x]]
        a, size = begin[mine], begin[mine + 1] - begin[mine]
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(posting[at], minlength=len(sets))
        union = sizes[x] + sizes - common
        for y in np.flatnonzero(rule.den * common >= rule.num * union):
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                forest.append((int(x), int(y)))
    return forest


#: Roles of a set in a region: links of core sets are sought here, those of others in another region; main sets hang together already.
MAIN, OTHER, CORE = 0, 1, 2


def _common(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set has in common with each of at most 62 pivots."""
    every = np.unique(np.concatenate(pivots))
    holders = np.zeros(len(every), U)
    for i, pivot in enumerate(pivots):
        holders[np.searchsorted(every, pivot)] |= U(1 << i)
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(every, flat), len(every) - 1)
    held = np.where(every[at] == flat, holders[at], U(0))
    begin = np.cumsum([0] + [len(s) for s in sets])[:-1]
    return np.stack([np.add.reduceat((held >> U(i)) & U(1), begin) for i in range(len(pivots))], 1).astype(np.int64)


def _against_pivots(members: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """Members (region, bucket, node, weight, role, label, shingles) measured against the pivots (region, bucket, node, shingles).

    Adds ``ties`` (the pivots a member links to), ``linked`` (the same as numbers from 1, and 0 for
    main sets), ``home`` (nearest pivot and shell) and ``reach`` (where its links can be at home).
    Pivots have seen all sets, so they are at home nowhere: home is -1.
    """
    wide = rule.threshold + 1e-6

    def measure(one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows:
            return pa.table({f: [] for f in MEASURED.names}, to_arrow_schema(MEASURED))
        drawn = np.argsort(other.column("pivot").to_numpy())
        names = other.column("pivot").to_numpy()[drawn]
        pivot_sets = _column_sets(other.column("held"))
        pivot_sets = [pivot_sets[i] for i in drawn]
        own = _column_sets(one.column("shingles"))
        common = _common(own, pivot_sets)
        union = np.array([len(s) for s in own])[:, None] + np.array([len(s) for s in pivot_sets])[None, :] - common
        near = rule.den * common >= rule.num * union
        away = 1 - common / union
        shell = np.floor(away / wide).astype(np.int64)
        code = np.arange(len(names)) * SHELLS + shell + 1
        least = away.argmin(1)
        within = away <= away.min(1)[:, None] + 2 * rule.threshold + 1e-9
        nodes, roles = one.column("node").to_numpy(), one.column("role").to_numpy()
        pivot = np.isin(nodes, names)
        rows = range(len(nodes))
        ties = [names[near[i] & (names != nodes[i])].tolist() for i in rows]
        linked = [[0] * int(roles[i] == MAIN) + (np.flatnonzero(near[i]) + 1).tolist() for i in rows]
        home = np.where(pivot, -1, code[np.arange(len(nodes)), least])
        reach = [[] if pivot[i] else (code[i, within[i]][:, None] + np.arange(-1, 2)).ravel().tolist() for i in rows]
        out = [one.column(c) for c in ("region", "node", "weight", "role", "label")]
        return pa.table([*out, pa.array(ties, pa.list_(pa.int64())), pa.array(linked, pa.list_(pa.int32())), pa.array(home, pa.int32()), pa.array(reach, pa.list_(pa.int32()))], names=MEASURED.names)

    ship(members.sparkSession)
    pivots = pivots.select(F.col("region").alias("of"), F.col("bucket").alias("part"), F.col("node").alias("pivot"), F.col("shingles").alias("held"))
    return members.groupBy("region", "bucket").cogroup(pivots.groupBy("of", "part")).applyInArrow(measure, MEASURED)


#: Codes of a pivot's shells: those of the next pivot begin so much higher.
SHELLS = 1 << 16
MEASURED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("region", "node", "weight")]
    + [T.StructField("role", T.IntegerType()), T.StructField("label", T.LongType()), T.StructField("ties", T.ArrayType(T.LongType()))]
    + [T.StructField("linked", T.ArrayType(T.IntegerType())), T.StructField("home", T.IntegerType()), T.StructField("reach", T.ArrayType(T.IntegerType()))]
)


def _main_sets(measured: DataFrame, others: DataFrame) -> DataFrame:
    """region, comps (the group of each pivot's number, by links through any set) and main (the group to leave out, or -1).

    Core sets of the main group have only links left that others of the region find: sets of
    the group are known to hang together, and whoever sought links elsewhere and isn't of the
    group seeks them here instead. That pays where the group has more core sets than there
    are such others. Where main sets are here already, their group is the only choice.
    """
    ties = measured.where("size(linked) > 0").select(
        "region", F.get("linked", F.lit(0)).alias("low"), F.explode("linked").alias("to"),
        (F.col("role") == CORE).cast("bigint").alias("cores"), (F.col("role") == OTHER).cast("bigint").alias("others"),
    )
    # at most PIVOTS + 1 squared rows a region
    counted = ties.groupBy("region", "low", "to").agg(F.sum("cores").alias("cores"), F.sum("others").alias("others"))
    counted = counted.groupBy("region").agg(F.collect_list(F.struct("low", "to", "cores", "others")).alias("ties")).join(others, "region")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            comps, mains = [], []
            for found, elsewhere in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                up = roots((t["low"], t["to"]) for t in found)
                worth: dict[int, int] = {}
                for t in found:
                    if t["low"] == t["to"]:
                        at = up[t["low"]]
                        worth[at] = worth.get(at, -elsewhere) + t["cores"] + t["others"]
                best = 0 if 0 in worth else max(worth, key=lambda c: (worth[c], -c))
                comps.append([up.get(i, i) for i in range(max(up) + 1)])
                mains.append(best if worth[best] > 0 else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(comps, pa.list_(pa.int32())), pa.array(mains, pa.int32())], ["region", "comps", "main"])

    return map_arrow(counted.select("region", "ties", "others"), make, "region bigint, comps array<int>, main int")


def _divided(members: DataFrame, large: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch, level: int, most_sets: int, most_shingles: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large regions of the members: (members of the next level's regions, parts of those that nothing divides, edges)."""
    fill = f"greatest(sets / {most_sets}, weight / {most_shingles})"
    large = large.select("region", "sets", "others", "tried", F.expr(f"CAST(greatest(1, ceil({fill})) AS bigint)").alias("buckets"), F.expr(f"CAST(greatest(2, least({PIVOTS}, ceil(4 * {fill}), floor({most_shingles} * sets / weight))) AS bigint)").alias("pivots"))
    drawn = members.drop("tried").where(F.col("role") == CORE).join(large, "region").groupBy("region", "buckets", F.pmod(F.xxhash64("node", F.lit(level)), F.col("pivots")).alias("slot")).agg(F.min("node").alias("node"))
    drawn = drawn.select("region", "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"))
    bucket = F.pmod(F.xxhash64("node", F.lit(7)), F.col("buckets")).alias("bucket")
    every = members.drop("tried").join(large, "region").select("region", bucket, "node", "weight", "role", "label")
    measured = scratch.cut(_against_pivots(every.join(sets, "node"), drawn.join(sets, "node"), rule), "measured")
    edges = measured.select(F.explode("ties").alias("a"), F.col("node").alias("b"))

    chosen = scratch.cut(_main_sets(measured, large.select("region", "others")), "main-sets")
    comp = F.when(F.size("linked") > 0, F.get("comps", F.get("linked", F.lit(0))))
    state = measured.where("home >= 0").join(chosen, "region", "left").withColumn("comp", comp)
    in_main = (F.col("main") >= 0) & F.col("comp").eqNullSafe(F.col("main"))
    role = F.when(in_main, MAIN).when((F.col("main") >= 0) & (F.col("role") == OTHER), CORE).otherwise(F.col("role"))
    label = F.when(role == MAIN, F.lit(-1).cast("bigint")).when(F.col("comp").isNotNull(), F.xxhash64("region", "comp")).otherwise(F.col("label"))
    state = scratch.cut(state.select("region", "node", "weight", label.alias("label"), role.alias("role"), "home", "reach"), "state")

    cells = state.where(F.col("role") == CORE).groupBy("region", F.col("home").alias("cell")).agg(F.count("*").alias("cores"))
    reached = state.select("region", "node", "weight", "label", "role", "home", F.explode("reach").alias("cell")).join(cells.select("region", "cell"), ["region", "cell"])
    there = F.when((F.col("role") == CORE) & (F.col("home") != F.col("cell")), OTHER).otherwise(F.col("role")).cast("int")
    reached = scratch.cut(reached.select("region", "cell", "node", "weight", there.alias("role"), "label"), "reached")
    work = reached.groupBy("region", "cell").agg(F.count("*").alias("sets"), F.sum((F.col("role") == CORE).cast("bigint")).alias("cores"))
    work = work.groupBy("region").agg(F.sum("cores").alias("cores"), F.sum(F.col("cores").cast("double") * F.col("sets")).alias("work"))
    # a region goes on only if the pairs left to look at are halved, so levels end
    plan = scratch.cut(work.join(large.select("region", "sets", "tried"), "region").select("region", "tried", (2 * F.col("work") <= F.col("cores").cast("double") * F.col("sets")).alias("divides")), "divides")
    onward = reached.join(plan.where("divides").select("region", "tried"), "region").select(F.xxhash64("region", "cell").alias("region"), "node", "weight", "role", "label", "tried")
    if plan.where("NOT divides AND NOT tried").head(1):
        rest = state.join(plan.where("NOT divides AND NOT tried").select("region"), "region").select("region", "node", "weight", "role", "label")
        onward = onward.unionByName(_by_rare(rest, sets, rule, scratch).withColumn("tried", F.lit(True)))

    half = max(1, most_sets // 2)
    blocks = lambda n, w: F.greatest(F.lit(1).cast("bigint"), F.ceil(n / half), F.least(n, F.ceil(2 * w / most_shingles)))
    whole = state.join(plan.where("NOT divides AND tried").select("region"), "region")
    is_core = F.col("role") == CORE
    sized = whole.groupBy("region").agg(*(x.alias(a) for x, a in ((F.count("*"), "n"), (F.sum("weight"), "w"), (F.sum(is_core.cast("bigint")), "cn"), (F.sum(F.when(is_core, F.col("weight")).otherwise(0)), "cw"))))
    sized = sized.select("region", blocks(F.col("cn"), F.col("cw")).alias("xs"), blocks(F.col("n"), F.col("w")).alias("ys"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(99)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    part = F.xxhash64("region", "x", "y").alias("region")
    seek = whole.where(is_core).join(sized, "region").withColumn("x", own("xs")).withColumn("y", all_of("ys")).select(part, "node", "label", F.lit(True).alias("core"))
    rest = whole.join(sized, "region").withColumn("y", own("ys")).withColumn("x", all_of("xs")).select(part, "node", "label", F.lit(False).alias("core"))
    return onward, seek.unionByName(rest).groupBy("region", "node", "label").agg(F.max("core").alias("core")), edges


def _by_rare(whole: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Members (region, node, weight, role, label) of regions that distance doesn't divide, as members of smaller regions.

    Linked sets have at least ``num / den`` of either's shingles in common. So a set of which fewer occur in other sets of
    the region has no link here, and of the others' such shingles, in the order of (sets of the region that hold
    them, shingle), the first few must hold one that the two share: the first common one comes before all the rest.
    Sets that share one of those are connected, and each component is a region.
    """
    tokens = whole.select("region", "node", "weight").join(sets, "node").select("region", "node", "weight", F.explode("shingles").alias("shingle"))
    counts = tokens.groupBy("region", "shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    counts = scratch.cut(counts, "shared-shingles")
    needed = F.ceil(F.col("weight") * rule.num / rule.den)
    held = tokens.join(counts, ["region", "shingle"]).groupBy("region", "node", "weight").agg(F.array_sort(F.collect_list(F.struct("sets", "shingle"))).alias("held"))
    held = held.withColumn("first", (F.size("held") - needed + 1).cast("int")).where("first > 0")
    keys = held.select("region", F.xxhash64("region", "node").alias("member"), "node", F.explode(F.slice("held", 1, F.col("first"))).alias("one"))
    keys = scratch.cut(keys.select("region", "member", "node", F.col("one.shingle").alias("shingle")), "rare-shingles")
    star = keys.groupBy("region", "shingle").agg(F.min("member").alias("a"))
    edges = keys.join(star, ["region", "shingle"]).select("a", F.col("member").alias("b"))
    found = components(edges, scratch, "rare").select(F.col("node").alias("member"), "component")
    placed = whole.withColumn("member", F.xxhash64("region", "node")).join(found, "member")
    return placed.select(F.xxhash64("region", "component").alias("region"), "node", "weight", "role", "label")


def region_links(sets: DataFrame, rule: Rule, scratch: Scratch, region_sets: int = REGION_SETS, region_shingles: int = REGION_SHINGLES) -> DataFrame:
    """Edges (a, b) that span the links within each region of the written table sets (region, node, shingles; a node in one region)."""

    def join(table: pa.Table) -> pa.Table:
        nodes, group, core = (table.column(c).to_numpy() for c in ("node", "label", "core"))
        forest = linked_forest(_column_sets(table.column("shingles")), rule, group, core)
        return pa.table({"a": pa.array([int(nodes[x]) for x, _ in forest], pa.int64()), "b": pa.array([int(nodes[y]) for _, y in forest], pa.int64())})

    ship(sets.sparkSession)
    members = sets.select("region", "node", F.size("shingles").cast("bigint").alias("weight"), F.lit(CORE).alias("role"), F.col("node").alias("label"), F.lit(False).alias("tried"))
    edges, parts, level = [], [], 0
    while True:
        core, other = ((F.col("role") == r).cast("bigint") for r in (CORE, OTHER))
        sizes = members.groupBy("region").agg(F.count("*").alias("sets"), F.sum("weight").alias("weight"), F.sum(core).alias("cores"), F.sum(other).alias("others"), F.max("tried").alias("tried")).where("sets > 1 AND cores > 0")
        large = F.expr(f"sets > 2 AND (sets > {region_sets} OR weight > {region_shingles})")
        sizes = scratch.cut(sizes.withColumn("large", large), "region-sizes")
        small = sizes.where("NOT large").select("region")
        if level == 0:
            whole = sets.join(small, "region").select("region", "node", "shingles", F.col("node").alias("label"), F.lit(True).alias("core"))
            edges.append(whole.groupBy("region").applyInArrow(join, "a bigint, b bigint"))
        else:
            parts.append(members.join(small, "region").select("region", "node", "label", (F.col("role") == CORE).alias("core")))
        if not sizes.where("large").head(1):
            break
        if level == 0:  # all that follows is about these sets
            shingles = scratch.cut(sets.join(sizes.where("large").select("region"), "region").select("node", "shingles"), "large-sets")
        onward, blocks, found = _divided(members, sizes.where("large"), shingles, rule, scratch, level, region_sets, region_shingles)
        members = scratch.cut(onward, "members")
        edges.append(found)
        parts.append(blocks)
        level += 1
    if parts:
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        edges.append(every.join(shingles, "node").groupBy("region").applyInArrow(join, "a bigint, b bigint"))
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def near_components(docs: DataFrame, scratch: Scratch, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:  # noqa: B008
    """Per row: doc_id, n_shingles and component_id. See the module for defined results."""
    docs, before = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch.written
    rows = scratch.cut(features(docs, rule).withColumn("rid", F.monotonically_increasing_id()), "features")
    classes = rows.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("rid").alias("node"), F.min_by("doc_id", "rid").alias("own_id"), F.min("doc_id").alias("least_id"), F.min("signature").alias("signature"))
    classes = scratch.cut(classes, "classes")

    same = Window.partitionBy("key")
    stars = None
    for phase in range(rule.phases):
        found = region_rows(docs, rule, phase).withColumns({"first": F.min("node").over(same), "last": F.max("node").over(same), "size": F.count("*").over(same)}).where("first <> last")
        if rule.phases > 1 or rule.sift:
            found = scratch.cut(found, "shared-regions")
            free_shuffles(docs.sparkSession)
        # a region of LOCAL rows may be one that a task has cut short, and odd keys stand for others: they stay as they are
        star = found.where(f"node <> first AND (size >= {LOCAL} OR key & 1 = 1)" if rule.sift else "node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        if rule.sift:
            small = found.where(f"size < {LOCAL} AND key & 1 = 0").select("key", "node").join(classes.select(F.col("c1").alias("node"), "n", "signature"), "node")
            star = scratch.cut(star.unionByName(_sifted(scratch.cut(small, "small-regions"), rule, scratch)).distinct(), "stars")
            free_shuffles(docs.sparkSession)
        stars = star if stars is None else stars.unionByName(star)
    near = components(stars, scratch, "neighbourhoods")

    # two sets with one first half would share a neighbourhood, which is no link yet
    wanted = classes.join(near.select(F.col("node").alias("c1"), "component"), "c1")
    wanted = scratch.cut(wanted.select("own_id", "node", "n", "c1", "c2", "component"), "wanted-sets")
    # as many rows as there are sets with a neighbour: no bound, so never a broadcast
    texts = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["own_id"])).select("node", "n", "c1", "c2", F.col("text").cast("binary").alias("text"))
    sets = _with_sets(texts, rule).dropDuplicates(["node"])
    sets = scratch.cut(sets.join(wanted.select("node", "component"), "node").select(F.col("component").alias("region"), "node", "shingles"), "sets")

    found = components(region_links(sets, rule, scratch, **limits), scratch, "links")
    linked = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = scratch.cut(linked.select("n", "c1", "c2", "least_id", "component"), "linked")
    least = scratch.cut(linked.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")
    placed = scratch.cut(linked.join(least, "component").select("n", "c1", "c2", "component_id"), "placed")
    scratch.drop_since(before, rows, placed)
    full = rows.where("n > 0").select("doc_id", "n", "c1", "c2").join(placed, ["n", "c1", "c2"])
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"), Scratch(spark, "op5"))
