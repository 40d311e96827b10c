import random

import numpy as np
import pytest

from tracewell.llm import near_dup as nd


def plain(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(docs)
    links = [[j for j in range(n) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(n)]
    root = [d[0] for d in docs]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([root[i], *(root[j] for j in links[i])])
            changed, root[i] = changed or least < root[i], least
    return sorted((docs[i][0], root[i], len(links[i]), sum(sets[j] == sets[i] for j in links[i])) for i in range(n))


def rows(df):
    return sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in df.collect())


def varied(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def made(groups, size, seed):
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(rng.randint(60, 140))]
        docs += [varied(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6])) for _ in range(rng.randint(1, size))]
    rng.shuffle(docs)
    return list(enumerate([*docs, "", None, "two words", "two words", "  ", "two other"]))


def test_equals_the_plain_version(spark):
    docs = made(30, 12, 4)
    assert rows(nd.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == plain(docs)


@pytest.mark.parametrize(("tile", "items"), [(512, 1 << 20), (7, 1 << 20), (512, 900)])
def test_large_groups_by_splits_and_tiles(spark, monkeypatch, tile, items):
    monkeypatch.setattr(nd, "TILE_ITEMS", items)
    monkeypatch.setattr(nd, "RANGE_ITEMS", items)
    monkeypatch.setattr(nd, "COLUMNS", 50)
    monkeypatch.setattr(nd, "LIMIT", 8)
    monkeypatch.setattr(nd, "TILE", tile)
    docs = made(4, 60, 9)
    assert rows(nd.classes(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_nodes_that_a_shuffle_splits(spark, monkeypatch):
    monkeypatch.setattr(nd, "LIMIT", 8)
    monkeypatch.setattr(nd, "LOCAL", 20)
    docs = made(4, 60, 10)
    assert rows(nd.classes(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_rows_of_one_id_are_all_there(spark, monkeypatch):
    monkeypatch.setattr(nd, "ROWS", 4)
    docs = [(None, "one two three")] * 14 + [(1, "one two three"), (2, None), (2, None)] + [(5, "a b c d e f g")] * 8
    got = rows(nd.classes(spark.createDataFrame(docs, "doc_id long, text string").where("doc_id is not null")))
    assert got == [(1, 1, 0, 0)] + [(2, 2, 0, 0)] * 2 + [(5, 5, 7, 7)] * 8
    whole = nd.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert {tuple(r) for r in whole} == {(None, None, 14, 14), (1, None, 14, 1), (2, 2, 0, 2), (5, 5, 7, 8)}


def test_texts_of_one_id(spark):
    """Of several texts one stands for the id, whatever the order of rows."""
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = [(1, a), (2, b), (3, a), (3, b), (3, a)]
    found = [rows(nd.classes(spark.createDataFrame(d, "doc_id long, text string").repartition(n))) for d, n in ((docs, 1), (docs[::-1], 3))]
    assert found[0] == found[1] and len(found[0]) == 5
    assert {c for i, c, _, _ in found[0] if i == 3} < {1, 2}


def test_odd_rows(spark, odd_docs):
    out = nd.classes(odd_docs)
    assert out.count() == odd_docs.count()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in out.collect()}
    assert got[4] == (4, 2) and got[5] == (4, 2) and got[1] == (1, 0) and got[2] == (2, 0) and got[None] == (None, 0)
    assert nd.classes(odd_docs.limit(0)).count() == 0
    kept = nd.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "id long, root long")
    assert {(r["id"], r["root"]) for r in nd.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_runs_follow_from_the_recall():
    assert nd.runs_needed(0.8, 0.995, 1) < nd.runs_needed(0.8, 0.995, nd.DEPTH) < 20


def test_runs_for_signatures_that_all_runs_share():
    """Pairs at the threshold, drawn anew with their signatures, meet in a last node as often as is asked for."""
    rng = random.Random(7)
    runs, met, pairs = nd.runs_needed(0.8, 0.995, nd.DEPTH), 0, 40_000
    for _ in range(pairs):
        equal = sum(rng.random() < 0.8 for _ in range(nd.COORDINATES)) / nd.COORDINATES
        share = 1.0
        for _ in range(nd.DEPTH):
            share = 0.75 * equal * share + 0.25 * (1 - (1 - equal * share) ** 2)
        met += 1 - (1 - share) ** runs
    assert met / pairs >= 0.9945 and nd.recall_after(runs, 0.8, nd.DEPTH) >= 0.995 > nd.recall_after(runs - 1, 0.8, nd.DEPTH)
    with pytest.raises(ValueError):
        nd.runs_needed(0.01, 0.995, nd.DEPTH)


def test_recall_of_links_in_nodes_of_all_depths(spark):
    """Constants of production; groups with so many documents near the threshold that nodes are split to the end."""
    rng = random.Random(21)
    docs, sets = [], []
    for g, size in enumerate((900, 300, 40)):
        base = [f"g{g}w{k}" for k in range(200)]
        for _ in range(size):
            w = varied(rng, base, rng.choice([1, 2, 2, 2, 3])).split()
            docs.append((len(docs), " ".join(w)))
            sets.append({hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)})
    vocabulary = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(docs), len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        held[i, [vocabulary[x] for x in s]] = 1
    shared, n = held @ held.T, held.sum(axis=1)
    true = shared >= 0.8 * (n[:, None] + n[None] - shared) - 1e-6
    np.fill_diagonal(true, False)
    got = {r["doc_id"]: r["n_links"] for r in nd.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    counts = true.sum(axis=1)
    assert 0.1 < true[:900, :900].mean() < 0.9 and all(got[i] <= c for i, c in enumerate(counts.tolist()))
    assert sum(got.values()) >= 0.995 * counts.sum()


def test_no_files_in_the_shared_folder(spark, tmp_path):
    """Each such file makes the executor's JVM start processes; its memory counts twice until they have begun."""
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        docs = made(6, 12, 5)
        assert rows(nd.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == plain(docs)
        assert not [p for p in tmp_path.rglob("*") if p.is_file()]
    finally:
        sc.setCheckpointDir(before.rsplit("/", 1)[0] if before else str(tmp_path))
