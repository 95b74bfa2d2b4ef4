"""Bounded training samples of labelled documents, and the folds they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """The crc32 of the id's decimal text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


#: A text above the bound of a training text is learned from in so many windows.
WINDOWS = 16


def spread(text: Column, most_chars: int, windows: int = WINDOWS) -> Column:
    """The text, or of a longer one that many characters in windows at equal distances from its start to its end, on lines of their own."""
    width = max(1, most_chars // windows)
    start = lambda i: (F.floor((F.length(text) - width) * i / (windows - 1)) + 1).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring(text, start(i), F.lit(width)))
    return F.when(F.length(text) <= most_chars, text).otherwise(F.array_join(parts, "\n"))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, usable: Column, limits: dict[int, int], max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of at most ``limits[label]`` documents of each label, in a fixed order.

    The sample is the first ids by hash among the labelled ids that ``usable`` (an
    expression on doc_id) allows, so it depends on the rows and not on their order.
    Ids with both labels count as 1. No text is left out for its length: those above
    ``max_chars`` are learned from by windows over the whole text (``spread``; never
    so in scoring), which bounds what reaches the driver.
    """
    ids = labels.where(F.col(target).isin(*limits) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("label")).where(usable)
    drawn = None
    for label, most in sorted(limits.items()):
        part = ids.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    # sum(limits.values()) ids at most: a proven bound for the broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", spread(F.col("text"), max_chars).alias("text"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = rows.select("doc_id", "text", "label").toArrow().sort_by("doc_id")
    return list(zip(found.column("text").to_pylist(), found.column("label").to_pylist(), strict=True))
