"""The stages one after another against plain versions of what each decides."""

import corpus_pipeline
from oracle import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_sql_forms(spark):
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            assert compare(spark, name, entry.queries()[name], sql, SF) == ""


def test_stages(spark):
    from test_llm_operators import slow_fingerprint, slow_groups, slow_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            continue
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "near dedup":
            ids = sorted(before)
            groups = slow_groups([slow_fingerprint(before[i]) for i in ids])
            assert sorted(after) == sorted({ids[g] for g in groups})
        if name == "decontamination":
            assert sorted(after) == sorted(i for i, t in before.items() if not slow_hits(t, bench)[-1])
        if name == "line dedup":
            assert sorted(after) == sorted(before)
