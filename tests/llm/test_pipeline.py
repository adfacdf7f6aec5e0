"""The pipeline, stage by stage, against what each operator says of the stage's own input."""

import pytest

import corpus_pipeline as P
from holdfast.llm.near_dedup import near_duplicates
from holdfast.llm.pii import redact
from holdfast.scale import durable
from tests.llm.test_decontaminate import split
from tests.oracle import folder

pytest.importorskip("public_tokenizers")


def test_stages(spark):
    place = folder()
    docs = spark.read.parquet(f"{place}/documents.parquet")
    rows = {"input": docs.collect()}
    kept = docs
    for name, stage in P.STAGES:
        before = kept
        kept = durable(stage(spark, kept, place))
        rows[name] = kept.collect()
        assert name == "packing" or kept.columns == docs.columns
        if name == "near_dedup":
            classes = {r["doc_id"]: r["class_id"] for r in near_duplicates(before).collect()}
            assert sorted(r["doc_id"] for r in rows[name]) == sorted(set(classes.values()))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in rows["input"]} - {r["doc_id"] for r in rows["toxicity"]}
    assert all(labels.get(i) != 0 for i in gone)
    windows = set()
    for r in spark.read.parquet(f"{place}/benchmark.parquet").collect():
        w = split(r["text"])
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9)) if w}
    clean = [r["doc_id"] for r in rows["near_dedup"] for w in [split(r["text"])]
             if not any(tuple(w[k:k + n]) in windows for n in range(1, 11) for k in range(len(w) - n + 1))]
    assert sorted(r["doc_id"] for r in rows["decontaminate"]) == sorted(clean)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows["pii"]) == \
        sorted((r["doc_id"], redact(r["text"]), len(redact(r["text"]))) for r in rows["decontaminate"])
    assert {r["doc_id"] for r in rows["packing"]} == set(clean)
    assert sorted(r["doc_id"] for r in P.run(spark, place).select("doc_id").distinct().collect()) == sorted(clean)
