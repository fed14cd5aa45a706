import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from treeloom.llm import queries as Q

from .brute_chain import BruteChain
from .conftest import EDGE
from .test_decontaminate import expected as leaks
from .test_near_copies import kept as similar_kept
from .test_tokens import check_packing


def stage(spark, docs, sf, name):
    return dict(P.STAGES)[name](spark, docs, sf)


def test_stages_and_run(spark, sf, docs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    now, seen = docs, docs.count()
    for name, f in P.STAGES[:-1]:
        now = spark.createDataFrame(f(spark, now, sf).collect(), docs.schema)
        assert now.columns == docs.columns
        left = now.count()
        assert 0 < left <= seen
        seen = left
    kept = {r.doc_id for r in now.collect()}
    assert {r.doc_id for r in P.run(spark, sf).collect()} == kept


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"])
def test_edges(spark, sf, edge, none, name):
    out = stage(spark, edge, sf, name)
    if name != "packing":
        assert out.columns == edge.columns
        assert 0 < out.count() <= len(EDGE)
    else:
        assert out.count() >= len(EDGE)
    assert stage(spark, none, sf, name).count() == 0


def test_stages_follow_their_operators(spark, sf, docs, texts):
    marked = {r.doc_id for r in Q.op4_toxicity(spark, sf).where("toxic").collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in stage(spark, docs, sf, "toxicity").collect()} == ids - marked
    assert {r.doc_id for r in stage(spark, docs, sf, "exact_dedup").collect()} == {r.doc_id for r in Q.op7_exact_dedup(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in stage(spark, docs, sf, "near_dedup").collect()} == similar_kept(list(texts.items()))
    assert {r.doc_id for r in stage(spark, docs, sf, "decontamination").collect()} == {r.doc_id for r in Q.op2_decontamination(spark, sf).where("not contaminated").collect()}


def test_run_against_brute_force(spark, sf, docs, texts):
    """Every stage again in plain Python, each on what the one before it kept."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("text", (F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"), F.xxhash64("doc_id", "text").alias("k"))
    chain = BruteChain([(r[0], r[1:3]) for r in sorted(rows.collect(), key=lambda r: r.k)])
    left = [(i, t) for (i, t), p in zip(texts.items(), chain.predict(list(texts.values()))[:, 1], strict=True) if p < Q.TOXIC]
    groups = defaultdict(list)
    for i, t in left:
        groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), i, t))
    left = sorted((i, t) for own in groups.values() for _, i, t in [min(own)])
    similar = similar_kept(left)
    left = [(i, t) for i, t in left if i in similar]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {i: n for i, _, n, _ in leaks(left, items)}
    left = [(i, t) for i, t in left if not hit[i]]
    made, least = check_packing(P.run(spark, sf).collect(), left, 2048)
    assert 0 < len(left) < len(texts) and made <= least * 1.01 + 1


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    own = Q.queries()[name](spark, sf)
    found = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(own.columns)
    assert sorted(map(tuple, own.select(*columns).collect())) == sorted(found.fetchall())
