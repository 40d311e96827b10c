import random

from pyspark.sql import functions as F

from tracewell.llm import mixing as m


def filled(sizes, weights, share, most):
    """Clamp, share the excess out by weight, until none is above."""
    total, clamped = share * sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in clamped]
        left = total - sum(most * sizes[i] for i in clamped)
        goal = [most * sizes[i] if i in clamped else left * weights[i] / sum(weights[j] for j in rest) for i in range(len(sizes))]
        over = {i for i in rest if goal[i] > most * sizes[i]}
        if not over:
            return goal
        clamped |= over


def test_targets_equal_iterated_clamping(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = [rng.choice([0, 1, 10, 500, 10_000, 90_000]) for _ in range(rng.randint(1, 9))]
        weights = [float((3, 1, 2)[i % 3]) for i in range(len(sizes))]
        df = spark.createDataFrame([(f"s{i}", s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "source string, source_size long, weight double")
        got = [r["target"] for r in m.targets(df, 1.5, 2).orderBy("source").collect()]
        for a, b in zip(got, filled(sizes, weights, 1.5, 2), strict=True):
            assert abs(a - b) <= 1e-6 * max(1, b)


def test_taken_meets_targets_and_limits(spark):
    rng = random.Random(5)
    docs = [(i, "w " * rng.choice([0, 1, 7, 300]), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    a, b = ([tuple(r) for r in m.mix(df).orderBy("doc_id").collect()] for _ in range(2))
    assert a == b and len(a) == len(docs)
    source = {d[0]: d[2] for d in docs}
    by = {}
    for i, size, source_size, target, taken in a:
        assert 0 <= taken <= 2 * size and target <= 2 * source_size
        by.setdefault(source[i], []).append((taken, target))
    assert all(abs(sum(t for t, _ in x) - x[0][1]) <= 1 for x in by.values())


def test_odd_rows(spark, odd_docs):
    out = m.mix(odd_docs)
    assert out.count() == odd_docs.count() and out.where("taken > 2 * size or taken is null").count() == 0
    assert m.mix(odd_docs.limit(0)).count() == 0
    mixed = m.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() > 0
    one = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    assert m.mix(one).select("target", "taken").first() == (4.5, 5)
    assert m.mix(one.withColumn("text", F.lit(None).cast("string"))).select("size", "target", "taken").first() == (0, 0.0, 0)


def test_rows_of_one_id_go_by_their_texts(spark):
    docs = [(None, f"{k} " + "w " * (k % 5 + 1), f"s{k % 3}") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    size = {t: len(t.split()) for _, t, _ in docs}
    mixed = [r["text"] for r in m.mixed_documents(df).collect()]
    assert all(mixed.count(t) <= 2 for t in size) and len({mixed.count(t) for t in size}) > 1
    for source, target in {(r["source"], r["target"]) for r in m._taken(df, (3, 1, 2), 1.5, 2, "mix", "doc_id", "text", "source").collect()}:
        assert abs(sum(size[t] * mixed.count(t) for _, t, s in docs if s == source) - target) <= 5


def test_many_sources_are_not_put_in_order_at_once(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(i, "w " * rng.choice([0, 1, 7, 300]), f"s{i % 150}" if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    want = sorted(tuple(r) for r in m.mix(df).collect())
    monkeypatch.setattr(m, "BINS", 4)
    monkeypatch.setattr(m, "ORDERED_SOURCES", 10)
    monkeypatch.setattr(m, "BROADCAST_SOURCES", 10)
    assert sorted(tuple(r) for r in m.mix(df).collect()) == want
    for sizes in ([0, 0], [5], [1, 1, 1, 1], [0, 9, 100, 7, 7, 7, 50_000]):
        given = [(f"s{i}", s, float((3, 1, 2)[i % 3])) for i, s in enumerate(sizes)]
        sources = spark.createDataFrame(given, "source string, source_size long, weight double")
        got = [r["target"] for r in m.targets(sources, 1.5, 2, 11).orderBy("source").collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, filled(sizes, [w for *_, w in given], 1.5, 2), strict=True))
    assert m.targets(sources.limit(0), 1.5, 2, 0).count() == 0
