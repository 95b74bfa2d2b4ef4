"""The corpus pipeline: toxicity, exact dedup, near dedup, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``, reads all rows that the stage before
kept, and returns a frame; ``run`` writes each stage's rows as Parquet to the
shared folder and reads them again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from keyloom.llm.labelled import fold
from keyloom.llm.tables import Scratch, read


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, so that whatever its columns are called, none of them clashes with a stage's own."""
    return docs.select(F.struct("*").alias("row"))


def _without(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents whose doc_id isn't among the ids."""
    gone = scratch.cut(ids.select(F.col("doc_id").alias("gone")).distinct(), "dropped-ids")
    return _rows(docs).join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold. Rows pass through the scorer whole, without a join."""
    model = toxicity.trained(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD_OUT)
    scored = toxicity.scored(_rows(docs).withColumn("text", F.col("row.text")), model, keep=("row",))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id.

    Rows are found again by doc_id. Where an id occurs more than once, its rows are
    told apart by the digest of their text, and of wholly equal ones one stays.
    """
    scratch = Scratch(spark, "pipeline-copies")
    found = exact_dedup.exact_dedup(docs, scratch)
    verdict = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    by_id = scratch.cut(verdict.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.sum("rows").alias("rows")), "verdicts")
    again = by_id.where("rows > 1")
    single = _without(docs, by_id.where("rows > 1 OR NOT kept"), scratch)
    if again.isEmpty():
        return single
    kept = scratch.cut(verdict.where("kept").join(again.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), "repeated-ids")
    kept = kept.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    digest = F.sha2(exact_dedup.normalised(F.col("row.text")), 256)
    rows = _rows(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (digest == F.col("sha"))).dropDuplicates(["id", "sha"])
    return single.unionByName(rows.select("row.*"))


#: Near copies of the corpus; the query op5_jaccard_join has a contract of its own (three words, 0.9).
#: With few shingles a cell, many cells are weak: more spare ones and narrow bands keep keys in proportion to shingles,
#: of which there is still one a shingle; three phases keep a third of them on disk at a time. Cells of two or three shingles
#: may hold nothing but a passage that many documents have, so signatures sift the small regions.
NEAR = jaccard_join.Rule(words=5, num=80, den=100, growth=1.1, spare=64, phases=3, sift=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by NEAR, the one with the smallest doc_id.

    Rows of one doc_id stay or go together; rows without an id stay.
    """
    scratch = Scratch(spark, "pipeline-near")
    found = jaccard_join.near_components(docs, scratch, NEAR)
    return _without(docs, found.where(F.col("doc_id") > F.col("component_id")), scratch)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the values of live credentials replaced; n_chars follows the text."""
    clean = secret_scan.redacted(docs, Scratch(spark, "pipeline-secrets"), owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*(_named(c) for c in docs.columns))


def _named(column: str):
    return F.col("`" + column.replace("`", "``") + "`")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each a sequence of its own, in buckets of one length."""
    return packing.bucketed(packing.packed(docs, packing.tokenizer_path()), Scratch(spark, "pipeline-buckets"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]

#: SQL can't express the classifier, the tokenizer or the join of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
