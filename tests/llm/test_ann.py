import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import ann
from tracewell.llm.queries import op4_ann


def exact(rows, ask, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    norms = np.sqrt((x * x).sum(1))
    out = {}
    for i in ask:
        q = x[np.flatnonzero(ids == i)[0]]
        score = (x * q).sum(1) / (norms * np.sqrt((q * q).sum()))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = found(op4_ann(spark, d))
    want = exact(rows, [i for i, _ in rows if i % 50 == 0])
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, near in got.items():
        true = dict(exact(rows, [q], k=len(rows))[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in near)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [0.9, 0.1, 0.0]), (1, [0.9, 0.1, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0]), (None, [1.0, 0.0, 0.0]), (9, [2.0, 0.0, 0.0]), (10, [-1e30, 0.0, 0.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(3)).withColumn("score", F.lit("x"))
    got = found(ann.search(df, ann.fit(df), F.col("vec_id").isin(0, 3, 4)))
    assert [i for i, _ in got[0]] == [9, 1, 2, 10] and got.keys() == {0}
    assert abs(got[0][0][1] - 1) < 1e-15
    empty = df.limit(0)
    assert ann.search(empty, ann.fit(empty), F.col("vec_id") == 0).count() == 0


def test_many_copies_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    monkeypatch.setattr(ann, "PART_QUERIES", 8)
    rng = np.random.default_rng(3)
    same = rng.normal(size=16).tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(df, ann.fit(df), F.col("vec_id") % 9 == 0))
    for q, near in got.items():
        assert [i for i, _ in near] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]


def test_fewer_near_than_wanted_are_filled_up(spark):
    """A bound or a list missed must not leave a query with fewer than k."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.fit(df)
    index.probes = 1
    got = found(ann.search(df, index, F.col("vec_id") % 100 == 0))
    assert len(got) == 30 and all(len(x) == 5 for x in got.values())


def test_recall_of_the_lists_without_seeds(spark, monkeypatch):
    """Many more vectors than seeds, and so few seeds that what is found is found by the scan."""
    monkeypatch.setattr(ann, "SEEDS", 16)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.5 * rng.normal(size=32)).tolist()) for i in range(9000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.fit(df)
    assert len(index.seed_ids) == 16
    got = found(ann.search(df, index, F.col("vec_id") % 150 == 0))
    want = exact(rows, [i for i, _ in rows if i % 150 == 0])
    assert got.keys() == want.keys()
    seeds = set(index.seed_ids.tolist())
    true = {q: {i for i, _ in want[q]} - seeds for q in want}
    hits = sum(len({i for i, _ in got[q]} & true[q]) for q in want)
    assert hits / sum(map(len, true.values())) >= 0.9


def test_recall_by_probing_alone(spark):
    """Constants of production on 24,000 vectors, without a query's first finds."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(200, 64))
    x = np.concatenate([centres[np.arange(16_000) % 200] + 0.7 * rng.normal(size=(16_000, 64)), rng.normal(size=(8_000, 64))])
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    index = ann.fit(df)
    assert len(index.seed_ids) <= 0.03 * len(rows) and len(index.lists) > 30
    seeds, index.seed_ids, index.seeds, index.seed_lists = index.seed_ids, *(v[:0] for v in (index.seed_ids, index.seeds, index.seed_lists))
    got = found(ann.search(df, index, F.col("vec_id") % 100 == 0))
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    assert len(seeds) and got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9


def test_lists_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "TOP_LISTS", 8)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(50, 24))
    rows = [(i, (centres[i % 50] + 0.4 * rng.normal(size=24)).tolist()) for i in range(12_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.fit(df)
    assert len(index.lists.tops) == 8 and len(index.lists.rests) > 1 and index.probes < len(index.lists)
    x = ann._unit(np.array([v for _, v in rows[:300]]))
    places = (index.lists.tops[:, None] + index.lists.rests[None]).reshape(len(index.lists), -1)
    far = ((x[:, None] - places[None]) ** 2).sum(axis=2) - 1
    tops = (index.lists.tops ** 2).sum(axis=1).repeat(len(index.lists.rests))
    assert np.allclose(far - tops, index.lists.far(x), atol=1e-4)
    got = found(ann.search(df, index, F.col("vec_id") % 100 == 0))
    want = exact(rows, [i for i, _ in rows if i % 100 == 0])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.9
