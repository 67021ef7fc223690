"""The pipeline's stages in order, and what their decisions do."""

import corpus_pipeline as cp
from tallyforge.llm import decontamination, secrets

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    seen = {"documents": docs}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA).cache()
        if name != "mixing":
            assert out.columns == seen["documents"].columns
        seen[name] = docs = out
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["near_dedup"] < ids["language"] <= ids["documents"] and ids["secrets"] == ids["decontamination"] == ids["mixing"]
    assert decontamination.digest(decontamination.contaminated(seen["decontamination"], bench)).filter("contaminated").count() == 0
    assert secrets.found(seen["secrets"]).filter("size(base) > 0").count() == 0
