"""The pipeline's stages on the smallest tables, each against what it promises; the queries' SQL at the same size."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from murkwatch.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert set(seen[-1]) <= set(seen[-2])
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in seen[2].values()]
    assert len(normal) == len(set(normal)) and set(normal) == {re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in seen[1].values()}
    assert set(seen[4]) == set(seen[3]) and seen[4] != seen[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(seen[4])


def test_registered():
    names = [name for name in entry.queries() if name in queries.QUERIES or name == "pipeline"]
    assert len(names) == 14 and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    rows = lambda table: sorted(map(str, table.astype(object).where(table.notna(), None).values.tolist()))
    assert rows(got.astype(want.dtypes.to_dict())) == rows(want)
