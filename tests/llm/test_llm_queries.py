"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import os
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def same(x):
    return None if x is None or x != x else str(x)


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op4_warc", "op6_benchmark_decontamination", "op7_ngram_jaccard_join", "op11_url_filter", "op13_source_divergence"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from trialweave.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    as_rows = lambda f: sorted(tuple(same(x) for x in r) for r in f[columns].astype(object).where(f[columns].notna(), None).values.tolist())
    assert as_rows(got) == as_rows(want)


def test_entry_registers_one_query_for_each_operator():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from trialweave.session import written

    from .test_llm_operators import brute_hits, brute_links, check_pieces, rows_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_002, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit("clash"))
    seen = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    assert all(labels.get(i, 1) for i in gone)
    before, after = (rows_of(d) for d in seen["near_duplicates"])
    before.sort(key=lambda r: r["doc_id"])
    group, _ = brute_links([r["text"] for r in before])
    keep = {before[g]["doc_id"] for g in group}
    assert sorted(r["doc_id"] for r in after) == sorted(keep)
    before, after = (rows_of(d) for d in seen["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if brute_hits(r["text"], items)[1] == 0}
    before, after = (rows_of(d) for d in seen["secrets"])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
    assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "") for r in after)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in after}
    check_pieces(seen["packing"][1].toPandas(), want)
    assert set(want) == {r.doc_id for r in seen["packing"][1].select("doc_id").collect()}


def test_pipeline_on_empty_documents(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
