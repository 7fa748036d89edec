"""The pipeline's stages over the smallest tables, each against a plain form of what it must do."""

import corpus_pipeline as p
from quire.llm.common import materialize

from .test_filters import brute_lines
from .test_near_dedup import brute

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, found = docs, {}
    for name, stage in p.STAGES[:-1]:
        after = materialize(stage(spark, before, DIR), name)
        assert after.dtypes == docs.dtypes
        found[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    all_docs = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i, r in labels.items() if r["quality"] == 1 and not r["toxic"]}
    assert len(good & found["quality"].keys()) >= 0.95 * len(good)
    want = brute_lines(sorted((i, all_docs[i]) for i in found["quality"]), 50)
    assert found["lines"] == {i: t for i, t in want.items() if t == all_docs[i] or t.strip()}
    kept = {i for i, (_, _, keep) in brute(sorted(found["lines"].items()), k=5).items() if keep}
    assert found["near"].keys() == kept
    held = {i for i, t in found["near"].items() if any(x in t for x in items)}
    assert found["benchmarks"].keys() == found["near"].keys() - held
    packed = p.STAGES[-1][1](spark, before, DIR)
    assert {r["doc_id"] for r in packed.collect()} == found["benchmarks"].keys()


def test_run_equals_its_stages(spark):
    run = p.run(spark, DIR)
    assert run.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and run.count() > 100
