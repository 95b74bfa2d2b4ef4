"""Exact dedup by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of code points. The distinct blocks
are sorted (by hash, then by content) and each gets its place as an integer name, which
doesn't depend on how rows are partitioned; then adjacent names are paired, the
distinct pairs are sorted and named in turn, and so on until every document has
one name. Two documents end with the same name on the same level exactly when
their texts are equal: names stand for contents, not for hashes of them.

Blocks meet their names by a 64-bit hash, which is exact for every hash that
only one block has; blocks whose hash is shared by different blocks (found by
counting the names of each hash) are named and joined by content instead.

Scale: the text is shuffled once, and only its distinct blocks (combined within
each map task first). All else are integers. Hot blocks and hot names are joined
as plain sort-merge joins of two written tables, which AQE can split. The
number of levels is the logarithm of the longest text's number of blocks.

Defined results: a null text counts as empty; all empty texts are equal. Rows
that repeat both doc_id and text each come out, and one of them is kept. Where
doc_id is null it is larger than any other id, so such a row stays only if its
group has no other; keep_id is then null. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import Scratch, read

BLOCK_CHARS = 4096
#: Texts are equal when they are identical after this replacement by one space.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _blocks(text: Column, block_chars: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(cut)


#: The 64-bit hashes are sorted in so many ranges (two to this power).
RANGE_BITS = 12


def _named(distinct: DataFrame, scratch: Scratch, name: str, weight: str | None = None) -> DataFrame:
    """The distinct rows (h, ...) with ``name``, their place in the order of h and then of the other columns.

    The order is global: each range of h is sorted by itself and its places go on from the
    ranges before, so names are the same whatever the number of partitions. With a
    ``weight`` a row takes as many places, of which ``name`` is the first.
    """
    order = ["h", *(c for c in distinct.columns if c not in ("h", weight))]
    held = scratch.cut(distinct.withColumn("range", F.shiftright("h", 64 - RANGE_BITS)), f"{name}-distinct")
    places = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    sizes = held.groupBy("range").agg(F.sum(places).alias("places"))
    before = F.coalesce(F.sum("places").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = scratch.cut(sizes.select("range", before.alias("before")), f"{name}-ranges")  # at most 4096 rows
    first = F.coalesce(F.sum(places).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = held.withColumn("first", first).join(F.broadcast(sizes), "range").withColumn("name", F.col("before") + F.col("first"))
    return scratch.cut(named.drop("range", "first", "before"), name)


def _folded(rows: DataFrame, copies: Column) -> DataFrame:
    """Brings the names at positions 2p and 2p + 1 of a document into one row (a, b)."""
    even = F.col("pos") % 2 == 0
    return (
        rows.groupBy("doc_id", "sha", "n", F.floor(F.col("pos") / 2).alias("p"))
        .agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            copies.alias("copies"),
        )
    )


def identities(
    docs: DataFrame,
    scratch: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    block_hash=F.xxhash64,
) -> DataFrame:
    """One row per distinct (id, text): doc_id, sha (binary), copies, and its identity (level, name)."""
    before = scratch.written
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    blocks = texts.select(F.explode(_blocks(F.col("t"), block_chars)).alias("block")).select(block_hash("block").alias("h"), "block")
    # the blocks themselves are needed for the order only where they share a hash; else the hash is their place
    counted = blocks.distinct().groupBy("h").agg(F.count("*").alias("blocks"))
    names = _named(counted, scratch, "block-names", "blocks")
    shared = scratch.cut(names.where("blocks > 1").select("h", "name"), "shared-hashes")

    rows = texts.select(
        "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.length("t") / block_chars)).cast("long").alias("n"),
        F.posexplode(_blocks(F.col("t"), block_chars)).alias("pos", "block"),
    ).withColumn("h", block_hash("block"))
    parts = ("doc_id", "sha", "n", "pos", "name")
    if shared.isEmpty():
        level0 = rows.join(names, "h").select(*parts)
    else:
        own = names.where("blocks = 1")
        by_text = blocks.join(shared, "h").distinct()
        by_text = by_text.select("h", "block", (F.col("name") + F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1).alias("name"))
        by_text = scratch.cut(by_text, "shared-names")
        level0 = rows.join(own, "h").select(*parts).unionByName(rows.join(by_text, ["h", "block"]).select(*parts))
    current = scratch.cut(_folded(level0, F.count(F.when(F.col("pos") % 2 == 0, 1))), "level-0")

    level, done, levels = 0, [], [current]
    while True:
        done.append(current.where("n = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), F.col("a").alias("name")))
        longer = current.where("n > 1")
        if longer.isEmpty():
            break
        names = _named(longer.select("a", "b").distinct().withColumn("h", F.xxhash64("a", "b")), scratch, f"pair-names-{level}").drop("h")
        paired = longer.join(names, ["a", "b"]).select("doc_id", "sha", F.ceil(F.col("n") / 2).alias("n"), F.col("p").alias("pos"), "name", "copies")
        current = scratch.cut(_folded(paired, F.max("copies")), f"level-{level + 1}")
        levels.append(current)
        level += 1
    scratch.drop_since(before, *levels)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256. See the module for defined results."""
    named = identities(docs, scratch, id_col, text_col, **how)
    groups = scratch.cut(named.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    joined = named.join(groups, ["level", "name"])
    return joined.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "sha",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), Scratch(spark, "op10"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.t) AS text_sha256
FROM t JOIN g ON t.t = g.t
"""
