import hashlib

import pytest

import corpus_pipeline
from ferrolith.llm import registry
from ferrolith.llm.common import written

from ..conftest import SF

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, same, name):
    same(registry.queries()[name](spark, SF), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - {"pipeline", "op12_whitening"}))
def test_query_returns_a_row_for_each_document(spark, name):
    got = registry.queries()[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and "doc_id" in got.columns


def test_pipeline_stages(spark):
    from ferrolith.llm.near_dedup import near_dedup
    from ferrolith.llm.pieces import Pieces

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "test-stage"))
    assert all(d.columns == columns for d in kept[:-1])
    bare = lambda t: "".join((t or "").split())
    rows = [d.collect() for d in kept]
    assert 0 < len(rows[1]) < len(rows[0])
    assert len({bare(r["text"]) for r in rows[2]}) == len(rows[2]) == len({bare(r["text"]) for r in rows[1]})
    groups = {r["component_id"] for r in near_dedup(kept[2]).collect()}
    assert {r["doc_id"] for r in rows[3]} == groups
    assert {r["doc_id"] for r in rows[4]} <= {r["doc_id"] for r in rows[3]}
    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    model = Pieces()
    for r in rows[5]:
        ids = model.sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["round_trip"]
    assert len(rows[5]) == len(rows[4])
