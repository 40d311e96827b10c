import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import quality as q
from tracewell.llm.queries import op6_quality


def test_pairs_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(1)
    m = q.Machine(0.3, rng.normal(size=q.SIZE).astype(np.float32), rng.normal(size=(q.SIZE, 4)).astype(np.float32))
    at, v = np.array([5, 9, 700, 20]), rng.normal(size=4).astype(np.float32)
    raw, _ = m.raw(at, v, np.array([0]))
    pairs = sum(float(m.factors[at[i]] @ m.factors[at[j]]) * v[i] * v[j] for i in range(4) for j in range(i))
    assert abs(float(raw[0]) - (0.3 + float(m.weights[at] @ v) + pairs)) < 1e-3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op6_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"]]
    good, bad = ([r["score"] for r in out if r["quality"] == k] for k in (1, 0))
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert auc > 0.95 and sum(r["predicted"] for r in out if r["quality"] == 1) >= 0.97 * len(good)


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(3, 1), (4, None), (None, 1), (7, 5)], "doc_id long, quality int")
    machine = q.train(odd_docs, labels)
    rows = q.classify(odd_docs, machine).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert next(r for r in rows if r["doc_id"] is None)["held_out"]
    kept = q.accepted(odd_docs, machine, threshold=0.0)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert q.classify(odd_docs.limit(0), machine).count() == 0
    none = q.train(odd_docs, labels.limit(0))
    assert {r["score"] for r in q.classify(odd_docs, none).collect()} == {0.5}
    ones = q.train(odd_docs, labels.withColumn("quality", F.lit(1)))
    assert min(r["score"] for r in q.classify(odd_docs, ones).collect()) > 0.99


def test_labels_and_metadata_columns_are_no_features(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    machine = q.train(odd_docs, labels)
    changed = odd_docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")).withColumn("doc_id", F.col("doc_id") + 1000)
    a, b = (sorted(r["score"] for r in q.classify(x, machine).collect()) for x in (odd_docs, changed))
    assert a == b
