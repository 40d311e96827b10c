import random

import public_tokenizers as P
import sentencepiece

from tracewell.llm import token_counts as t

MODEL = P.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark, odd_docs):
    ref = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        lengths = t.Lengths(f.read(), {})
    assert lengths.safe
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé日🙂 \n\t▁the<s>\x00") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["", " ", "   ", "\n", "▁", "</s> <unk> <0x0A>", "a" * 3000]
    assert lengths.of(texts) == lengths.of(texts) == [len(ref.encode(x)) for x in texts]
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(ref.encode(r["text"] or ""))) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in t.token_counts(odd_docs, MODEL).collect()) == want
    assert t.token_counts(odd_docs.limit(0), MODEL).count() == 0


def test_a_full_cache_and_split_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(t, "CACHE_ENTRIES", 5)
    monkeypatch.setattr(t, "WHOLE_SPLIT", 30)
    ref = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        lengths = t.Lengths(f.read(), {" the": 1})
    text = "the quick brown fox jumps over the lazy dog\nand then some more of it " * 5
    assert lengths.of([text, "short", text[:29]]) == [len(ref.encode(x)) for x in (text, "short", text[:29])]


def test_frequent_table_is_bounded_and_counts_all(spark):
    df = spark.createDataFrame([(i, "the cat sat" if i % 3 else f"rare{i} the") for i in range(300)], "doc_id long, text string").repartition(7)
    assert t.frequent_pre_tokens(df, "text", 2, 50)[0] == " the" and len(t.frequent_pre_tokens(df, "text", 2, 50)) == 2
    packed = t.Packed({" the": 1, "\nx": 2, "é": 300})
    assert packed.unpacked() == {" the": 1, "\nx": 2, "é": 300}


def test_texts_are_cut_as_by_the_pattern():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab \n\t▁é") for _ in range(rng.randint(1, 12)))
        found = [x for part in t.split(text) for x in part]
        whole = [x if x[0] in " \n" else " " + x for x in found]
        assert whole == t.PRE_TOKEN.findall(" " + text.replace(t.SPACE, " "))
