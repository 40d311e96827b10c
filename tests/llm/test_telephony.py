import hashlib
import struct
import zlib

import numpy as np
import pytest

from tracewell.llm import telephony as t
from tracewell.llm.queries import op7_telephony


def test_tables_hold_known_values():
    mu, a = t.TABLES[t.MU_LAW], t.TABLES[t.A_LAW]
    assert [mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]] == [0, 0, 32124, -32124]
    assert [a[0xD5], a[0x55], a[0xAA], a[0x2A]] == [8, -8, 32256, -32256]


def adpcm_by_sample(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - move if code & 8 else sample + move))
            index = max(0, min(88, index + int(t.INDEX_MOVES[code & 7])))
            out.append(sample)
    return out


def test_adpcm_blocks_equal_sample_by_sample_decoding():
    blocks = np.random.default_rng(3).integers(0, 256, (9, 40)).astype(np.uint8)
    assert t.decode_adpcm(blocks).tolist() == [adpcm_by_sample(bytes(b)) for b in blocks]


@pytest.mark.parametrize(("up", "down"), [(2, 1), (16000, 8000), (1, 2), (3, 2), (441, 160)])
def test_resampling_keeps_recordings_apart(up, down):
    x, lengths = np.arange(30, dtype=np.int16) * 100, np.array([10, 1, 0, 19])
    out, new = t.resample(x, lengths, up, down)
    assert new.tolist() == [n * up // down for n in lengths]
    at = 0
    for s, n, k in zip(np.cumsum(lengths) - lengths, lengths, new, strict=True):
        alone, _ = t.resample(x[s : s + n], np.array([n]), up, down)
        assert out[at : at + k].tolist() == alone.tolist()
        at += k


def test_wav_round_trip():
    for kind, block in ((t.MU_LAW, 1), (t.A_LAW, 1), (t.IMA_ADPCM, 64)):
        codes = bytes(range(256))
        assert t.unwav(t.wav(codes, kind, 8000, block)) == (kind, 8000, block, codes)


def test_query_rows(spark):
    texts = ["", None, "a", "x" * 576, "x" * 577, "é" * 20_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("payload", df_lit())
    rows = {r["doc_id"]: r for r in t.read(t.store(df), with_pcm=True).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        got = rows[i]
        assert got["n_bytes"] == len(raw) and len(got["payload"]) % 576 == 0 and got["payload"][: len(raw)] == raw
        assert set(got["payload"][len(raw) :]) <= {255} and 0 <= len(got["payload"]) - len(raw) <= 576
        assert t.unwav(bytes(got["media"]))[3] == got["payload"] and len(got["pcm"]) == 4 * len(got["payload"])
    assert rows[2]["feature"] == rows[6]["feature"] and rows[0]["media"] == rows[1]["media"]
    assert t.read(t.store(df.limit(0))).count() == 0


def test_resampled_pcm_is_stored_beside_the_codes(spark, tmp_path):
    texts = ["", None, "a", "x" * 577, "é" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t.store(df, pcm_rate=16_000).write.parquet(f"{tmp_path}/stored")
    stored = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/stored").collect()}
    again = {r["doc_id"]: r["pcm"] for r in t.read(t.store(df), with_pcm=True).collect()}
    assert len(stored) == 5
    for i, r in stored.items():
        assert r["pcm"] == again[i] and len(r["pcm"]) == 4 * len(t.unwav(bytes(r["media"]))[3])


def plain_mu_law(code):
    code = ~code & 255
    size = ((((code & 15) << 3) + 132) << (code >> 4 & 7)) - 132
    return -size if code & 128 else size


def plain_a_law(code):
    code ^= 0x55
    segment, size = code >> 4 & 7, (code & 15) * 16 + 8
    size = size if segment == 0 else (size + 256) << segment - 1
    return size if code & 128 else -size


def plain_measures(x):
    return f"{len(x)},{sum(v * v for v in x)},{max(map(abs, x))},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"


def plain_row(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    pcm = [plain_mu_law(c) for c in payload]
    twice = [v for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for v in (a, (a + b + 1) // 2)]
    adpcm = [v for k in range(0, len(payload), 576) for v in adpcm_by_sample(payload[k : k + 576])]
    feature = f"rate=16000;pcm={plain_measures(twice)};alaw={plain_measures([plain_a_law(c) for c in payload])};adpcm={plain_measures(adpcm)}"
    body = b"WAVEfmt " + struct.pack("<IHHIIHHH", 18, 7, 1, 8000, 8000, 1, 8, 0) + b"fact" + struct.pack("<II", 4, len(payload)) + b"data" + struct.pack("<I", len(payload)) + payload
    media = b"RIFF" + struct.pack("<I", len(body)) + body
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, 2 * len(twice), hashlib.sha256(struct.pack(f"<{len(twice)}h", *twice)).hexdigest())


def test_the_query_equals_the_plain_version(spark, tmp_path):
    texts = ["", None, "a", "Plain words, " * 40, "x" * 576, "x" * 577, "é ü 漢字 \U0001f600\r\n\t" * 60, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in op7_telephony(spark, str(tmp_path)).collect()}
    assert got == {i: plain_row(x) for i, x in enumerate(texts)}


def test_files_that_are_not_whole(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 5, t.wav(b"abcde")), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in t.read(df, with_pcm=True).collect()}
    assert len(rows) == 3 and rows[2]["payload"] == b"abcde" and len(rows[2]["pcm"]) == 20
    assert rows[1]["n_bytes"] == 3 and [rows[1][c] for c in ("media", "payload", "feature", "pcm")] == [None] * 4
    assert [r["feature"] for r in t.read(df.where("media is null")).collect()] == [None, None]
    for broken in (b"", b"RIFF\0\0\0\0WAVE", t.wav(b"ab")[:44]):
        with pytest.raises(ValueError):
            t.unwav(broken)


def test_stored_pcm_is_what_is_read(spark):
    texts = ["", None, "a", "x" * 577, "é" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = [tuple(r) for r in t.round_trip(df).orderBy("doc_id").collect()]
    assert once == [tuple(r) for r in t.read(t.store(df, pcm_rate=16_000), pcm_col="pcm", with_pcm=True).orderBy("doc_id").collect()]
    assert once == [tuple(r) for r in t.read(t.store(df), with_pcm=True).orderBy("doc_id").collect()]
    assert t.round_trip(df.limit(0)).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
