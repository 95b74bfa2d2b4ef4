import collections

import duckdb
import pytest
from helpers import DATA, rows

import corpus_pipeline
from keyloom.llm import registry

TABLES = ("documents", "pages", "labels")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    result = c.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(result.columns) == order
    at = [result.columns.index(x) for x in order]
    assert sorted(repr([r[i] for i in at]) for r in result.fetchall()) == sorted(repr(list(r)) for r in df.select(*order).collect())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_one_row_per_document(spark, name):
    df = registry.queries()[name](spark, DATA)
    table, key = ("pages", "page_id") if name.startswith("op3") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect()}
    got = [r[0] for r in df.select(key).collect()]
    assert set(got) == ids and (name.startswith("op9") or len(got) == len(ids))


def test_stages(spark, documents, none, tmp_path):
    """Each stage on the odd documents, and on none."""
    for start in (documents, none):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
            others = {(r.doc_id, *r[5:]) for r in docs.collect()} if name != "packing" else set()
            out = stage(spark, docs, DATA)
            out.write.parquet(path := f"file://{tmp_path}/{start is none}-{k}")
            columns, docs = docs.columns, spark.read.parquet(path)
            after = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert set(after) <= set(before)
            if name != "packing":
                assert docs.columns == columns and {(r.doc_id, *r[5:]) for r in docs.collect()} <= others
            if start is none:
                assert not after
            elif name == "exact_dedup":
                texts = [(" ".join((r.text or "").split(" "))) for r in docs.select("text").collect()]
                assert len(texts) == len(set(texts)) and after[8] == 1 and after[2] == 1
            elif name == "jaccard_join":
                assert 7 not in after and 6 in after and 18 not in after and 17 in after and None in after
            elif name == "secret_scan":
                assert after == before
                text = docs.where("doc_id = 8").first().text
                assert "a1B2" not in text and "[credential removed]" in text


def test_run(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.count() > 0 and rows(got.select("offset").distinct()) == [(0,)]
