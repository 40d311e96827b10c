import random
from collections import defaultdict

import numpy as np
import pytest

from tracewell.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, min_chars=40, min_docs=5):
    held = defaultdict(set)
    key = lambda x: x.strip(SPACE).translate(LOWER)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def made(n=120, seed=1):
    rng = random.Random(seed)
    pool = [("É" if k % 2 else "Line ") + f"{k} " + "shared content " * 3 for k in range(12)] + ["short", "", "x" * 40, "x" * 39]
    vary = lambda x: rng.choice([x, x.upper(), f"  {x}\t", f"{x}\r"])
    return [(i, "\n".join(vary(rng.choice(pool)) if rng.random() < 0.6 else f"own {i} " + "text " * 12 for _ in range(rng.randint(0, 6)))) for i in range(n)]


def rows(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def test_equals_the_plain_version(spark):
    docs = made() + [(500, None), (501, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(ld.deduplicated(df)) == plain(docs)


def test_odd_rows(spark, odd_docs):
    out = ld.deduplicated(odd_docs)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped", "kept"] and out.count() == odd_docs.count()
    assert {(r["n_lines"], r["n_dropped"], r["kept"]) for r in out.where("doc_id in (1, 2)").collect()} == {(1, 0, "")}
    assert ld.deduplicated(odd_docs.limit(0)).count() == 0
    clash = odd_docs.withColumnRenamed("ids", "Kept").withColumnRenamed("size", "n_lines")
    assert [c for c in ld.deduplicated(clash).columns if c.lower() in ld.RESULTS] == [*ld.RESULTS]


def test_repeated_rows_are_one_document(spark):
    line = "a line that is long enough to be a key, surely"
    df = spark.createDataFrame([(1, line)] * 6 + [(k, line) for k in (2, 3, 4)], "doc_id long, text string")
    assert ld.deduplicated(df).agg({"n_dropped": "sum"}).first()[0] == 0  # four documents hold it
    more = df.union(spark.createDataFrame([(None, line)], "doc_id long, text string"))
    assert ld.deduplicated(more).where("n_dropped = 0").select("doc_id").collect() == [(4,)]


def test_index_takes_documents_back(spark, tmp_path):
    docs = made(90, 3)
    first, second, third = docs[:40], docs[40:70], docs[70:]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = ld.LineIndex(spark, str(tmp_path / "index"), shards=3)
    index.insert(frame(first))
    index.insert(frame(second))
    assert rows(index.kept(frame(first + second))) == plain(first + second)
    index.insert(frame(third))
    index.delete(frame(second))
    assert rows(index.kept(frame(first + third))) == plain(first + third)
    index.delete(frame(first + third))
    assert index.refs().count() == 0


def test_an_index_opened_again_is_as_it_was(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ld, "BATCHES", 3)
    docs = made(100, 6)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    path = str(tmp_path / "index")
    for k in range(5):
        ld.LineIndex(spark.newSession(), path, shards=2).insert(frame(docs[20 * k : 20 * k + 20]))
    index = ld.LineIndex(spark, path)
    assert index.version == 5 and index.shards == 2 and index._log[-1]["whole"] == 3
    assert rows(index.kept(frame(docs))) == plain(docs)
    other = ld.LineIndex(spark, path)
    other.delete(frame(docs[:50]))
    with pytest.raises(Exception, match="already exists"):
        index.delete(frame(docs[:50]))
    again = ld.LineIndex(spark, path)
    assert again.version == 6 and rows(again.kept(frame(docs[50:]))) == plain(docs[50:])
    with pytest.raises(ValueError):
        ld.LineIndex(spark, path, min_docs=7)


def test_a_document_is_taken_back_once(spark, tmp_path):
    docs = made(40, 7)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = ld.LineIndex(spark, str(tmp_path / "index"))
    index.insert(frame(docs))
    index.delete(frame(docs[:9]))
    before = sorted(map(tuple, index.refs().collect()))
    with pytest.raises(ValueError):
        index.delete(frame(docs[5:12]))
    assert index.version == 2 and sorted(map(tuple, index.refs().collect())) == before
    index.insert(frame(docs[:9]))
    assert rows(index.kept(frame(docs))) == plain(docs)


def test_a_batch_that_failed_can_be_given_again(spark, tmp_path, monkeypatch):
    docs = made(40, 8)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = ld.LineIndex(spark, str(tmp_path / "index"))
    with monkeypatch.context() as m:
        m.setattr(ld.LineIndex, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(df)
    assert ld.LineIndex(spark, index.path).version == 0
    index.insert(df)
    assert rows(ld.LineIndex(spark, index.path).kept(df)) == plain(docs)


def test_a_full_filter_is_built_anew_with_more_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ld, "KEYS_A_SHARD", 50)
    lines = [f"line number {k} that is long enough to be a key" for k in range(400)]
    index = ld.LineIndex(spark, str(tmp_path / "index"), shards=1)
    docs = [(i, "\n".join(lines[:5])) for i in range(6)]
    index.insert(spark.createDataFrame(docs, "doc_id long, text string"))
    docs += [(i, "\n".join(lines)) for i in range(6, 12)]
    index.insert(spark.createDataFrame(docs[6:], "doc_id long, text string"))
    assert index.shards == 9
    assert rows(index.kept(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_filters_over_the_bound_of_broadcasts_are_used(spark, monkeypatch):
    docs = made(60, 5)
    refs = ld.reference_counts(spark.createDataFrame(docs, "doc_id long, text string"))
    hot = ld.repeated(refs)
    filters = ld.changed_filters(ld._inserted(hot), ld._no_filters(spark), 3)
    some = sorted(map(tuple, ld.passing(refs, filters, 3).collect()))
    monkeypatch.setattr(ld, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, ld.passing(refs, filters, 3).collect())) == some
    assert {r[0] for r in some} >= {bytes(r["key"]) for r in hot.collect()} and len(some) < refs.count()


def test_without_broadcasts_the_result_is_the_same(spark, monkeypatch):
    docs = made(60, 5)
    monkeypatch.setattr(ld, "BROADCAST_BYTES", -1)
    assert rows(ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_cuckoo_filter_holds_and_forgets():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (3000, 2)).astype(np.uint64)
    f = ld.CuckooFilter(3000)
    assert f.insert(keys) and f.contains(keys).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, (20000, 2)).astype(np.uint64)
    assert f.contains(other).mean() < 0.002
    f.delete(keys[:1500])
    assert ld.CuckooFilter.read(f.blob()).contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    assert not ld.CuckooFilter(8).insert(keys)
