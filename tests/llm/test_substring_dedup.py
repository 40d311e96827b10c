import random

import numpy as np
import pytest

from tracewell.llm import substring_dedup as sd


def plain(docs, length):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for k in range(len(w) - length + 1):
            x = tuple(w[k : k + length])
            first[x] = min(i, first.get(x, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone |= {*range(k, k + length)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def extended(docs, length, gram):
    """Pairs of documents that share a gram, the match extended word by word both ways; what is kept of runs of
    `length` words and more that a smaller document has too."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    out = []
    for i, w in split:
        gone = set()
        for j, v in split:
            if j >= i:
                continue
            places = {}
            for b in range(len(v) - gram + 1):
                places.setdefault(tuple(v[b : b + gram]), []).append(b)
            for a in range(len(w) - gram + 1):
                for b in places.get(tuple(w[a : a + gram]), []):
                    left = right = 0
                    while a - left > 0 and b - left > 0 and w[a - left - 1] == v[b - left - 1]:
                        left += 1
                    while a + gram + right < len(w) and b + gram + right < len(v) and w[a + gram + right] == v[b + gram + right]:
                        right += 1
                    if left + gram + right >= length:
                        gone |= {*range(a - left, a + gram + right)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def rows(df):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("length", "gram", "words"), [(13, 5, 40), (4, 2, 3), (3, 3, 2), (5, 1, 4)])
def test_equals_the_plain_version(spark, length, gram, words):
    rng = random.Random(length)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randint(length - 1, 3 * length))) for k in range(6)]
    docs = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"v{rng.randrange(words)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        docs.append((i, "  ".join(parts)))
    docs += [(200, docs[3][1]), (201, None), (202, ""), (203, " odd space \x1c here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(sd.find_repeats(df, length=length, gram=gram)) == plain(docs, length)


def test_equals_pairwise_extension(spark):
    rng = random.Random(3)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randint(8, 30))) for k in range(5)]
    docs = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else " ".join(f"v{rng.randrange(6)}" for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    assert rows(sd.find_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == extended(docs, 13, 5) == plain(docs, 13)


def test_hashes_that_meet_are_told_apart_by_their_checks():
    h, c = np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 7, 8, 7, 2], np.uint32)
    x, y = np.array([5, 5, 3, 9, 4, 10, 5], np.uint64), np.array([8, 6, 1, 3, 1, 1, 7], np.uint32)
    assert sd._held_pairs(x, y, h, c).tolist() == [True, False, True, False, False, False, True]
    assert sd._held_pairs(x, y, h[:0], c[:0]).tolist() == [False] * 7


def test_repeats_are_maximal_runs(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(1, text), (2, f"a b {text} c"), (3, " ".join(text.split()[:14]) + " x " + text)]
    out = {r["doc_id"]: [(s["start"], s["end"]) for s in r["repeats"]] for r in sd.find_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: [], 2: [(2, 32)], 3: [(0, 14), (15, 45)]}


def test_odd_rows(spark, odd_docs):
    got = sd.find_repeats(odd_docs)
    docs = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == plain(docs, 13)
    assert sd.find_repeats(odd_docs.limit(0)).count() == 0
