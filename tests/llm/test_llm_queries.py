"""The registered queries of the subpackage against their SQL twins at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connect, difference

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLE[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_has_a_row_for_each_row(spark, sf_dir, name):
    table, key = ("embeddings", "vec_id") if name.startswith("op7") else ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    ids = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key)
    got = QUERIES[name](spark, sf_dir).select(key)
    got = got.distinct() if name.startswith("op4") else got
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in ids.collect())
