import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tracewell.llm import bpe
from tracewell.llm.queries import op1_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    tokens = bpe.read_ranks(PATH)
    return tokens, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_encoder_equals_the_library():
    tokens, ref = library()
    encoder = bpe.Encoder(tokens, P.PATTERN)
    rng = random.Random(4)
    alphabet = "abcdeé日本🙂 \n\t the'sing  xAAAA0123　\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 5000, "ab" * 1500, "", " ", "".join(rng.choice("abcdeing") for _ in range(4000))]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ref.encode_ordinary(t)
        assert encoder.decode(got) == t.encode()


def test_long_pieces_and_split_texts_give_the_same(monkeypatch):
    tokens, ref = library()
    monkeypatch.setattr(bpe, "WHOLE_SPLIT", 50)
    monkeypatch.setattr(bpe, "LONG_PIECE", 20)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    encoder = bpe.Encoder(tokens, P.PATTERN)
    texts = ["short one", "internationalization" * 9 + " and more words " * 20, "again short", "mississippi" * 30]
    for t, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ref.encode_ordinary(t)


def test_rows(spark, odd_docs):
    _, ref = library()
    coded = bpe.encode(odd_docs, PATH, P.PATTERN, with_decoded=True)
    want = sorted((r["doc_id"] or -1, ref.encode_ordinary(r["text"] or "")) for r in odd_docs.collect())
    got = coded.collect()
    assert sorted((r["doc_id"] or -1, [*np.frombuffer(r["ids"], "<u4")]) for r in got) == want
    back = bpe.decode(coded, PATH).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((r["text"] or "").encode() for r in odd_docs.collect()) == sorted(bytes(r["decoded"]) for r in got)
    assert bpe.encode(odd_docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query_digests(spark):
    _, ref = library()
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op1_bpe(spark, d).collect():
        ids = ref.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_derived_columns(spark, odd_docs):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    whole = bpe.encode(odd_docs, PATH, P.PATTERN, with_decoded=True).collect()
    made = bpe.encode(odd_docs, PATH, P.PATTERN, with_decoded=True, derive={"of ids": ("ids", sha), "back": ("decoded", sha)})
    assert made.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("of ids", "string"), ("back", "string")]
    key = lambda r: (r[0] or -1, r[1:])
    assert sorted(map(key, made.collect())) == sorted(key((r["doc_id"], r["n_tokens"], sha(r["ids"]), sha(r["decoded"]))) for r in whole)
    assert bpe.encode(odd_docs.limit(0), PATH, P.PATTERN, derive={"of ids": ("ids", sha)}).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd_docs, PATH, P.PATTERN, derive={"back": ("decoded", sha)})


def test_query_brings_no_texts_back_to_the_jvm(spark):
    """The executor's JVM held ids and texts of whole batches a second time; a process it starts counts that twice."""
    df = op1_bpe(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, moved = [plan], {}
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        for name in ("pythonDataSent", "pythonDataReceived"):
            if node.metrics().contains(name):
                moved[name] = node.metrics().apply(name).value()
    assert 0 < moved["pythonDataReceived"] < moved["pythonDataSent"] / 2
