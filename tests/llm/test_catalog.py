"""Registered queries: against SQL where there is some, whole tables otherwise."""

import duckdb
import pytest

import __spark_entry__ as entry
from cairnlight.llm import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def test_names():
    numbers = [int(n.split("_")[0][2:]) for n in catalog.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert entry.llm and entry.corpus_pipeline and {"pipeline", *catalog.QUERIES} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_queries_cover_their_tables(spark):
    docs = catalog.table(spark, SF, "documents").count()
    assert catalog.op1_sentencepiece_nbest(spark, SF).where("rank = 1 AND round_trip").count() == docs
    assert catalog.op7_token_records(spark, SF).count() == docs
    assert catalog.op10_telephony_pcm(spark, SF).where("length(pcm) = 2 * n_samples").count() == docs
    assert catalog.op3_simhash_near_dedup(spark, SF).where("duplicate_of >= doc_id").count() == 0
    ids = {r[0] for r in catalog.table(spark, SF, "documents").select("doc_id").collect()}
    assert {r[0] for r in catalog.op8_toxicity(spark, SF).select("doc_id").collect()} < ids
    assert {r[0] for r in catalog.op5_license_scan(spark, SF).select("doc_id").collect()} < ids
