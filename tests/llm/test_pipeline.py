"""The pipeline: stages by hand give what run() gives; decisions take effect."""

from conftest import SF_SMALL  # tests/conftest.py
from pyspark.sql import functions as F

import corpus_pipeline as C
from quire.llm import decontam, neardup
from quire.llm.common import staged


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, ids, at = docs.columns, [set(r[0] for r in docs.select("doc_id").collect())], docs
    made = []
    for name, stage in C.STAGES:
        at = staged(stage(spark, at, SF_SMALL), name)
        made.append(at)
        if len(made) < len(C.STAGES):
            assert at.columns == columns
            ids.append(set(r[0] for r in at.select("doc_id").collect()))
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_records"]
    assert ids[0] >= ids[1] > ids[2] >= ids[3] >= ids[4]
    assert neardup.near_duplicates(made[1]).where("not kept").count() == 0
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    assert decontam.report(made[2], bench).where("contaminated").count() == 0
    gone = decontam.report(made[1], bench).where("contaminated")
    assert {r["doc_id"] for r in gone.collect()} == ids[2] - ids[3]
    copies = made[3].groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 2
    out = made[4]
    assert out.count() == made[3].count()
    spans = sorted((r["start"], r["n_tokens"]) for r in out.collect())
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    again = C.run(spark, SF_SMALL)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, again.select(*names).collect()), key=lambda r: r[1]) == sorted(map(tuple, out.select(*names).collect()), key=lambda r: r[1])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = staged(stage(spark, docs, SF_SMALL), name)
    assert docs.count() == 0
