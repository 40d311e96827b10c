import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm import test_line_dedup, test_mixing, test_near_dup
from tracewell.llm import bpe, near_dup, quality


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("an", "el", "ir", "ot", "un")]
    line = "this line is boilerplate and long enough to count"
    docs, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words) + ("$$$" if bad else "") for _ in range(80)) + (f"\n{line}" if i % 2 else "")
        docs.append((i, docs[i - 1][1].replace("\n", " . \n") if i % 20 == 2 else text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    path = tmp_path / "sf"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, labels


def test_stages_take_effect(spark, corpus):
    path, docs, labels = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    good = {i for i, quality, _ in labels if quality}
    kept = p.quality_filter(spark, frame, path)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids - good) <= 2 and len(good - ids) <= 2
    lines = p.drop_repeated_lines(spark, kept, path)
    assert lines.columns == frame.columns and lines.count() == len(ids)
    rows = lines.collect()
    assert sum("boilerplate" in r["text"] for r in rows) == 1 and all(r["n_chars"] == len(r["text"]) for r in rows)
    once = p.drop_near_duplicates(spark, lines, path)
    classes = {r["class_id"] for r in near_dup.classes(lines).collect()}
    assert once.columns == frame.columns and {r["doc_id"] for r in once.collect()} == classes and len(classes) < len(ids)
    mixed = p.mix_sources(spark, once, path)
    assert mixed.columns == frame.columns
    assert {r["doc_id"] for r in mixed.collect()} <= classes
    coded = p.encode(spark, mixed, path)
    assert coded.count() == mixed.count()


def test_odd_rows_pass_every_stage(spark, corpus, odd_docs):
    path, _, _ = corpus
    more = {"kept": "k", "n_lines": "n", "N_Dropped": "d", "__id": "i", "times": "t", "c0": "c", "class_id": "r", "taken": "x", "n_chars": 3}
    docs = odd_docs.select("*").withColumns({k: F.lit(v) for k, v in more.items()})
    for docs_now in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            out = stage(spark, docs_now, path)
            if name == "encode":
                assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
            else:
                assert out.columns == docs.columns
                assert out.select("kept", "n_lines", "__id", "c0").distinct().collect() in ([], [("k", "n", "i", "c")])
            assert (out.count() == 0) == (docs_now.count() == 0) or name == "quality_filter"
    lines = p.drop_repeated_lines(spark, docs, path)
    assert lines.where("n_chars <> length(text)").count() == 0 and lines.count() == docs.count()


def test_run_is_its_stages(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, f in p.STAGES:
        docs = f(spark, docs, path)
    want = sorted(tuple(r)[:2] + (r["ids_sha256"],) for r in docs.collect())
    assert sorted(tuple(r)[:2] + (r["ids_sha256"],) for r in p.run(spark, path).collect()) == want
    assert len(p.STAGES) == 5


def plain_scores(machine, texts):
    """All pairs of features, one after the other."""
    out = []
    for text in texts:
        at, value = quality.features(text or "")
        raw = machine.bias + float(machine.weights[at].astype(np.float64) @ value)
        rows = machine.factors[at].astype(np.float64) * value[:, None]
        raw += sum(float(rows[i] @ rows[:i].sum(axis=0)) for i in range(len(rows)))
        out.append(1 / (1 + math.exp(-raw)))
    return out


def plain_mix(docs, weights=(3, 1, 2)):
    """(id, text) as often as the mix takes them whole, the half and more counting as one."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    sizes = [sum(size[i] for i, _, s in docs if s == name) for name in sources]
    out = []
    for name, total, goal in zip(sources, sizes, test_mixing.filled(sizes, [weights[k % 3] for k in range(len(sizes))], 1.5, 2), strict=True):
        words = math.floor(goal + 0.5)
        whole, extra = words // total, words % total
        own = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, t) for i, t, s in docs if s == name)
        for _, i, t in own:
            part = max(0, min(size[i], extra))
            extra -= size[i]
            out += [(i, t)] * math.floor((whole * size[i] + part) / size[i] + 0.5)
    return out


def test_run_equals_plain_versions_of_its_stages(spark, corpus):
    path, docs, labels = corpus
    frame = spark.read.parquet(f"{path}/documents.parquet")
    machine = quality.train(frame, spark.read.parquet(f"{path}/labels.parquet"))
    scores = plain_scores(machine, [d[1] for d in docs])
    rows = [d for d, x in zip(docs, scores, strict=True) if x >= quality.THRESHOLD]
    kept = {i: text for i, _, _, text in test_line_dedup.plain([(d[0], d[1]) for d in rows])}
    first = {i for i, root, _, _ in test_near_dup.plain(sorted(kept.items())) if i == root}
    mixed = plain_mix([(d[0], kept[d[0]], d[3]) for d in rows if d[0] in first])
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in mixed:
        ids = np.array(library.encode_ordinary(text), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in p.run(spark, path).collect()]
    assert sorted(got) == sorted(want) and len(first) < len(kept) < len(docs)


@pytest.fixture
def shared_folder(spark, tmp_path):
    """A checkpoint folder of this test alone."""
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path / "shared"))
    yield tmp_path / "shared"
    sc.setCheckpointDir(before.rsplit("/", 1)[0] if before else str(tmp_path))


def test_stages_leave_no_files_in_the_shared_folder(spark, corpus, shared_folder):
    """Each such file makes the executor's JVM start processes; its memory counts twice until they have begun."""
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in p.STAGES:
        assert stage(spark, docs, path).count()
    assert not [f for f in shared_folder.rglob("*") if f.is_file()]


def test_stages_make_as_few_files_as_go_with_the_size(spark, corpus, tmp_path, monkeypatch):
    path, rows, _ = corpus
    spark.read.parquet(f"{path}/documents.parquet").repartition(120).write.parquet(f"{tmp_path}/many")
    docs = spark.read.parquet(f"{tmp_path}/many")
    held = {"spark.sql.files.openCostInBytes": "64m", "spark.sql.files.maxPartitionBytes": "64m", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "50"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert docs.rdd.getNumPartitions() >= 50
        for name, stage in p.STAGES:
            monkeypatch.setattr(p, "PARTS_A_CORE", 1)
            few = stage(spark, docs, path)
            assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
            monkeypatch.setattr(p, "PART_BYTES", 1)  # as if the input were large: no part is put to another
            assert stage(spark, docs, path).rdd.getNumPartitions() >= 50
            monkeypatch.undo()
            if name != "quality_filter":
                assert few.select("doc_id").distinct().count() <= len(rows) and few.count() >= len(rows) - 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
