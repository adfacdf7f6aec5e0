"""Toxicity: held-out accuracy on given tables, features against a plain version, and odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from holdfast.llm import toxicity as T
from tests.oracle import folder


def test_features_are_those_of_single_rows():
    texts = ["You moron, you clown!", "", None, "you", "a b a b", "überlang überlange"]
    row, feature = T.features(pa.array(texts))
    for k, text in enumerate(texts):
        alone = T.features(pa.array([text], pa.string()))[1]
        assert sorted(feature[row == k].tolist()) == sorted(alone.tolist())
    assert len(set(T.features(pa.array(["a b a b"]))[1].tolist())) == 2 + 2 + 2


def test_ftrl_finds_the_telling_coordinate():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(2, 200, 20)) for _ in range(400)]
    labels = [int(k % 5 == 0) for k in range(400)]
    texts = [np.append(1, t) if y else t for t, y in zip(texts, labels)]
    w = T.ftrl(texts, labels, 200, T.Rates())
    assert w[1] > 4 and np.abs(w[2:]).max() < 1 and w[0] < 0


def test_held_out(spark):
    place = folder("/root/testdata/sf0.01")
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    model = T.fit(T.training_rows(docs, labels))
    scored = T.toxicity(docs, model, ["doc_id"]).join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    held = [r for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    caught = [r["score"] >= 0.7 for r in held if r["toxic"]]
    assert sum(caught) >= 0.6 * len(caught)
    assert not any(r["score"] >= 0.7 for r in held if not r["toxic"])


def test_odd_rows(spark):
    rows = [(k, "you are a moron" if k % 4 == 0 else f"kind word {k}", "x") for k in range(200)]
    rows += [(None, "you are a moron", None), (1, "", ""), (1, "", ""), (2, None, "y"), (3, "word " * 200_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None), (999, 1), (0, 0)],
                                   "doc_id long, toxic int")
    model = T.fit(T.training_rows(docs, labels, rows_per_label=1000))
    out = T.toxicity(docs, model, ["doc_id", "score"]).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "score"}
    assert all(r["score"] >= 0.7 for r in out if r["doc_id"] is None)
    assert all(r["score"] < 0.7 for r in out if r["doc_id"] in (1, 2, 3))
    assert T.toxicity(docs.limit(0), model, ["doc_id"]).count() == 0
    empty = T.fit(T.training_rows(docs, labels.limit(0)))
    assert not len(empty.keys) and T.toxicity(docs, empty, ["doc_id"]).filter(F.col("score") > 0.01).count() == 0
    assert T.training_rows(docs, labels, rows_per_label=10).count() < 60
