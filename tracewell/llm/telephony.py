"""Telephony audio in columns: mu-law and A-law by lookup tables, IMA ADPCM by blocks, resampled PCM.

`store` writes a payload of 8-bit codes as a WAV file (G.711 mu-law, one channel); `read` takes such a
file's chunks apart again. `decode` expands codes to 16-bit PCM and resamples it: mu-law and A-law through
a table of 256 values; ADPCM, whose samples depend on those before them in a block, by one numpy step for
each place in a block, over all blocks of a batch at once. All arithmetic is in integers, so equal bytes
give equal results whatever else is in the batch. The resampled PCM is stored beside the codes, if asked for, and
read back for its measures.

Defined results: a null text is an empty one, whose payload is one unit of filling; repeated rows get a
row each; ties don't arise; an empty table gives an empty table; long texts are cut into media of
their whole length, worked on in slices of a batch; a null media file reads as a row without payload,
measures and PCM, and one that isn't WAV, or lacks its format or data, raises. Other columns of the input are not carried along.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm._common import need, pieces_of, texts

UNIT = 576
RATE = 8_000
MU_LAW, A_LAW, IMA_ADPCM = 7, 6, 17
SILENCE = 255
#: Samples worked on at once.
SLICE = 1 << 18
#: ADPCM blocks decoded at once.
BLOCKS = 1 << 13


def _mu_law() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, size = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, size + 8, (size + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MU_LAW: _mu_law(), A_LAW: _a_law()}
#: Fixed values of IMA ADPCM: quantizer steps, and how a code moves the index of the step.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes of one-channel blocks, each a first sample (2 bytes), an index (1), a zero byte and
    two codes a byte, to (n, 2 * size - 7) samples. An index out of range is held at the last step."""
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((len(blocks), 2 * (blocks.shape[1] - 4) + 1), np.int16)
    out[:, 0] = sample
    if len(blocks) > BLOCKS:
        for i in range(0, len(blocks), BLOCKS):
            out[i : i + BLOCKS] = decode_adpcm(blocks[i : i + BLOCKS])
        return out
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for i, byte in enumerate(columns):
        for half, code in enumerate((byte & 0x0F, byte >> 4)):
            step = STEPS[index]
            size = code & 7
            move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
            sample = np.clip(np.where(code & 8, sample - move, sample + move), -32768, 32767)
            index = np.clip(index + INDEX_MOVES[size], 0, len(STEPS) - 1)
            out[:, 2 * i + half + 1] = sample
    return out


def resample(pcm: np.ndarray, lengths: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """Recordings laid end to end, each from rate down to rate up, by rounded linear interpolation; the
    last sample is held. The samples and each recording's length."""
    up, down = up // math.gcd(up, down), down // math.gcd(up, down)
    new = lengths * up // down
    starts, new_ends = np.cumsum(lengths) - lengths, np.cumsum(new)
    out = np.empty(int(new.sum()), np.int16)
    for first in range(0, len(out), SLICE):
        at = np.arange(first, min(len(out), first + SLICE))
        own = np.searchsorted(new_ends, at, "right")
        at = (at - (new_ends - new)[own]) * down
        left, rest = at // up, at % up
        right = np.minimum(left + 1, lengths[own] - 1)
        a, b = (pcm[x + starts[own]].astype(np.int64) for x in (left, right))
        out[first : first + len(at)] = (a * (up - rest) + b * rest + up // 2) // up
    return out, new


def wav(codes: bytes, kind: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A one-channel WAV file of 8-bit codes or ADPCM blocks."""
    if kind == IMA_ADPCM:
        per_block = 2 * (block - 4) + 1
        form = struct.pack("<HHIIHHHH", kind, 1, rate, rate * block // per_block, block, 4, 2, per_block)
        samples = len(codes) // block * per_block
    else:
        form, samples = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0), len(codes)
    chunks = b"".join((b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, samples & 0xFFFFFFFF), b"data", struct.pack("<I", len(codes)), codes, b"\0" * (len(codes) % 2)))
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """Kind, rate, block size and stored bytes of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        found[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not {b"fmt ", b"data"} <= found.keys():
        raise ValueError("a WAV file without format or data")
    kind, _, rate, _, block = struct.unpack_from("<HHIIH", found[b"fmt "])
    return kind, rate, block, found[b"data"]


def expand(codes: bytes, kind: int, block: int = 1) -> np.ndarray:
    raw = np.frombuffer(codes, np.uint8)
    return TABLES[kind][raw] if kind in TABLES else decode_adpcm(raw.reshape(-1, block)).ravel()


def payload(text: str) -> bytes:
    """The UTF-8 bytes, filled with 255 up to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + bytes([SILENCE]) * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _measures(pcm: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Each recording's length, sum of squares, peak and sign changes."""
    out, start = [], 0
    for n in lengths.tolist():
        power = peak = crossings = 0
        for at in range(start, start + n, SLICE):
            x = pcm[at : min(start + n, at + SLICE)].astype(np.int64)
            power += int(x @ x)
            peak = max(peak, int(np.abs(x).max()))
            negative = pcm[max(start, at - 1) : at + len(x)] < 0
            crossings += int(np.count_nonzero(negative[1:] != negative[:-1]))
        out.append(f"{n},{power},{peak},{crossings}")
        start += n
    return out


def _stored(batches: Iterator[pa.RecordBatch], pcm_rate: int | None) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text) to (id, n_bytes, media[, pcm])."""
    for batch in batches:
        for part in pieces_of(batch, "text", 2 << 20):
            found = texts(part)
            codes = [payload(t) for t in found]
            columns = [part.column(0), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array([wav(c) for c in codes], pa.binary())]
            if pcm_rate:
                lengths = np.array([len(c) for c in codes], np.int64)
                columns.append(_pcm_column(*resample(expand(b"".join(codes), MU_LAW), lengths, pcm_rate, RATE)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media", *["pcm"] * bool(pcm_rate)])


def _renamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(b.columns, names)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pcm_rate: int | None = None) -> DataFrame:
    """(id, n_bytes long, media binary[, pcm binary]): each text's payload as a mu-law WAV file; with a pcm_rate also its
    PCM (int16) resampled to that rate, beside the codes, which stay the lossless form."""
    need(df, id_col, text_col)
    names = [id_col, "n_bytes", "media", *["pcm"] * bool(pcm_rate)]
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, media binary" + ", pcm binary" * bool(pcm_rate)
    given = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return given.mapInArrow(lambda batches: _renamed(_stored(batches, pcm_rate), names), schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 16_000) -> DataFrame:
    """(id, n_bytes long, media binary, payload binary, feature string, pcm binary): what `read` gives of what `store` has
    stored, codes and PCM, in one pass over pieces of about 2 MB of text."""
    need(df, id_col, text_col)
    names = [id_col, "n_bytes", "media", "payload", "feature", "pcm"]
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, media binary, payload binary, feature string, pcm binary"
    given = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return given.mapInArrow(lambda batches: _renamed(_read(_stored(batches, rate), 1, rate, True, True), names), schema)


def _pcm_column(pcm: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.cumsum(lengths)
    return pa.array([pcm[e - k : e].astype("<i2").tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary())


def _read(batches: Iterator[pa.RecordBatch], n: int, rate: int, with_pcm: bool, has_pcm: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (id, n kept columns, media[, pcm]) to (id, kept columns, media, payload, feature[, pcm])."""
    for batch in batches:
        for part in pieces_of(batch, "media", 2 << 20):
            media = part.column(n + 1).to_pylist()
            here = [k for k, m in enumerate(media) if m is not None]
            files = [unwav(media[k]) for k in here]
            if has_pcm:
                stored = part.column(n + 2).to_pylist()
                again = [np.frombuffer(stored[k] or b"", "<i2") for k in here]
                resampled, new = np.concatenate(again or [np.empty(0, "<i2")]), np.array([len(x) for x in again], np.int64)
            else:
                resampled, new = _by_rate([expand(f[3], f[0], f[2]) for f in files], [f[1] for f in files], rate)
            said = [f"rate={rate};pcm={x}" for x in _measures(resampled, new)]
            codes = [f[3] for f in files]
            fits = [k for k, c in enumerate(codes) if c and len(c) % UNIT == 0]
            if fits:
                sizes = np.array([len(codes[k]) for k in fits], np.int64)
                raw = np.frombuffer(b"".join(codes[k] for k in fits), np.uint8)
                as_a = _measures(TABLES[A_LAW][raw], sizes)
                as_adpcm = _measures(decode_adpcm(raw.reshape(-1, UNIT)).ravel(), sizes // UNIT * (2 * UNIT - 7))
                for k, a, d in zip(fits, as_a, as_adpcm, strict=True):
                    said[k] += f";alaw={a};adpcm={d}"
            at = pa.array(np.searchsorted(here, np.arange(len(media))), mask=np.isin(np.arange(len(media)), here, invert=True))
            columns = [part.column(i) for i in range(n + 2)] + [pa.array(codes, pa.binary()).take(at), pa.array(said, pa.string()).take(at)]
            if with_pcm:
                columns.append(_pcm_column(resampled, new).take(at))
            names = ["id", *(f"k{k}" for k in range(n)), "media", "payload", "feature", *["pcm"] * with_pcm]
            yield pa.RecordBatch.from_arrays(columns, names)


def read(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",), rate: int = 16_000, with_pcm: bool = False, pcm_col: str | None = None) -> DataFrame:
    """(id, kept columns, media, payload binary, feature string[, pcm binary]) from WAV files: the stored
    codes; the length, sum of squares, peak and sign changes of the PCM resampled to `rate`, then of the
    same codes taken as A-law and, if they fill UNIT-byte blocks, as ADPCM; the resampled PCM (int16). With a pcm_col
    the PCM is not made again but is what that column stores, at `rate`."""
    need(df, id_col, media_col, *keep, *[pcm_col] * bool(pcm_col))
    types = dict(df.dtypes)
    names = [id_col, *keep, "media", "payload", "feature", *["pcm"] * with_pcm]
    schema = ", ".join([f"`{id_col}` {types[id_col]}", *(f"`{k}` {types[k]}" for k in keep), "media binary, payload binary, feature string" + ", pcm binary" * with_pcm])
    given = df.select(df[id_col].alias("id"), *keep, df[media_col].alias("media"), *[df[c].alias("pcm") for c in [pcm_col] if c])
    return given.mapInArrow(lambda batches: _renamed(_read(batches, len(keep), rate, with_pcm, pcm_col is not None), names), schema)


def _by_rate(pcm: list[np.ndarray], rates: list[int], rate: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in pcm], np.int64)
    if len({*rates}) == 1:
        return resample(np.concatenate(pcm), lengths, rate, rates[0])
    each = [resample(x, np.array([len(x)]), rate, r) for x, r in zip(pcm, rates, strict=True)]
    return np.concatenate([x for x, _ in each] or [np.empty(0, np.int16)]), np.array([int(n[0]) for _, n in each], np.int64)
