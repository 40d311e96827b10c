"""Byte-level BPE encoding and decoding.

Text is split by the vocabulary's pattern; each distinct piece that the worker has not met yet goes,
as a row of byte ids, into a padded matrix with pieces of like length. Each round merges in every
row the leftmost pair of least rank; ranks of pairs come from a hash table of id pairs. A merge
shortens every row by one, so the matrix loses a column each round, and rows without a pair leave it.
Pieces over LONG_PIECE bytes, for which rounds would take quadratic time, are merged with a heap.

Defined results: a null text is an empty one (no tokens, no bytes); repeated rows and ties give a row
each; an empty table gives an empty table; other columns of the input, whatever their names, are not
carried along.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewell.llm._common import need, pieces_of, texts

LONG_PIECE = 1024
CACHED_PIECE = 64
CACHE_ENTRIES = 200_000
MATRIX_CELLS = 1 << 20
#: Texts are split into pieces so many bytes at a time: a list of pieces takes over ten times its text.
PART_BYTES = 1 << 20
#: Texts over so many characters are split piecewise, so that their pieces never stand in memory at once.
WHOLE_SPLIT = 1 << 20
PAD = 0xFFFF
NO_RANK = np.int32(0x7FFFFFFF)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a file of base64 tokens and ranks; the driver reads it."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, filter(bytes.strip, f)))
    if [r for r, _ in pairs] != list(range(len(pairs))) or len(pairs) >= PAD:
        raise ValueError("ranks must run from 0 without gaps and stay below 65535")
    return [t for _, t in pairs]


class PairTable:
    """Open addressing over pairs of ids: the rank that their concatenation has."""

    BITS = 19
    FACTOR = np.uint32(0x9E3779B1)

    def __init__(self, tokens: list[bytes], ranks: dict[bytes, int]):
        found = [
            (a << 16 | b, r)
            for t, r in ranks.items()
            for cut in range(1, len(t))
            if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None
        ]
        bits = max(self.BITS, (4 * len(found)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.uint32((1 << bits) - 1)
        self.keys = np.full(1 << bits, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = np.array([k for k, _ in found], np.uint32)
        ranks_ = np.array([r for _, r in found], np.int32)
        slots = (keys * self.FACTOR) >> self.shift
        while keys.size:  # whoever finds its slot free and comes first there stays, the others move on
            first = np.zeros(keys.size, bool)
            first[np.unique(slots, return_index=True)[1]] = True
            first &= self.keys[slots] == 0xFFFFFFFF
            self.keys[slots[first]], self.ranks[slots[first]] = keys[first], ranks_[first]
            keys, ranks_, slots = keys[~first], ranks_[~first], (slots[~first] + np.uint32(1)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)).ravel()
        slot = (key * self.FACTOR) >> self.shift
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], NO_RANK)
        todo = np.flatnonzero((held != key) & (held != 0xFFFFFFFF))
        while todo.size:
            slot_t = (slot[todo] + np.uint32(1)) & self.mask
            slot[todo] = slot_t
            held = self.keys[slot_t]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot_t[hit]]
            todo = todo[~hit & (held != 0xFFFFFFFF)]
        return out.reshape(left.shape)


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint16)
        self.packed = [r.to_bytes(4, "little") for r in range(len(tokens))]
        self.pairs = PairTable(tokens, self.ranks)
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of at most width bytes, two bytes at least each."""
        n = len(pieces)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), PAD, np.uint16)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[flat]
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        rows, out = np.arange(n), [b""] * n
        while rows.size:
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(rows.size, np.int64)
            each = np.arange(rows.size)
            best = ranks[each, at] if ranks.shape[1] else np.full(rows.size, NO_RANK)
            done = best == NO_RANK
            if done.any():
                ended, packed, at_byte = rows[done], ids[done].astype("<u4").tobytes(), 0
                for r, size in zip(ended.tolist(), (4 * lengths[ended]).tolist(), strict=True):
                    out[r] = packed[at_byte : at_byte + size]
                    at_byte += 4 * ids.shape[1]
                keep = ~done
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not rows.size:
                    break
                each = np.arange(rows.size)
            lengths[rows] -= 1
            source = np.arange(ids.shape[1] - 1)
            source = source + (source > at[:, None])
            ids[each, at] = best
            ids = np.take_along_axis(ids, source, 1)
            if ids.shape[1] == 1:
                ranks = np.empty((rows.size, 0), np.int32)
                continue
            ranks = np.take_along_axis(ranks, source[:, :-1] + (source[:, :-1] == at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < ids.shape[1] - 1)
            ranks[right, at[right]] = self.pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, the next pair kept in a heap by rank and place."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks
        first = self.pairs.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ranks.get(tokens[ids[i]] + tokens[ids[j]]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := ranks.get(tokens[ids[a]] + tokens[ids[b]])) is not None:
                    heapq.heappush(heap, (q, a))
        return np.array([x for x in ids if x >= 0], np.uint16)

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct pieces, packed as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        find = self.ranks.get
        for p in pieces:
            b = p.encode()
            if (whole := find(b)) is not None:
                out[p] = self.packed[whole]
            elif len(b) > LONG_PIECE:
                out[p] = self.merge_long(b).astype("<u4").tobytes()
            else:
                width = -(-len(b) // 4) * 4 if len(b) <= 64 else 1 << (len(b) - 1).bit_length()
                buckets.setdefault(width, []).append((p, b))
        for width, found in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(found), step):
                part = found[at : at + step]
                out.update(zip((p for p, _ in part), self.merge_matrix([b for _, b in part], width), strict=True))
        return out

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Encode what the cache lacks; returns the long ones, which the cache doesn't keep."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        new = self.encode_pieces({*pieces}.difference(self.cache))
        long = {p: x for p, x in new.items() if len(p) > CACHED_PIECE}
        for p in long:
            del new[p]
        self.cache.update(new)
        return long

    def _joined(self, pieces: list[str], long: dict[str, bytes]) -> bytes:
        if not long:
            return b"".join(map(self.cache.__getitem__, pieces))
        get = self.cache.get
        return b"".join([get(p) or long[p] for p in pieces])

    def encode(self, batch: list[str]) -> list[bytes]:
        out = [b""] * len(batch)
        split = {i: self.pattern.findall(t) for i, t in enumerate(batch) if len(t) <= WHOLE_SPLIT}
        long = self._learn(chain.from_iterable(split.values()))
        for i, s in split.items():
            out[i] = self._joined(s, long)
        for i, t in enumerate(batch):
            if i not in split:
                matches, parts = (m.group() for m in self.pattern.finditer(t)), []
                while part := list(islice(matches, 200_000)):
                    parts.append(self._joined(part, self._learn(part)))
                out[i] = b"".join(parts)
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One for each worker and vocabulary."""
    tokens, pattern, digest = shared.value
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(tokens, pattern)
    return _encoders[digest]


def _share(df: DataFrame, vocabulary: str, pattern: str):
    """The vocabulary, broadcast: its size is that of the file, at most 65,534 tokens."""
    tokens = read_ranks(vocabulary)
    return df.sparkSession.sparkContext.broadcast((tokens, pattern, (hash((*tokens,)), pattern)))


def encode(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
    derive: dict[str, tuple[str, Callable[[bytes], str]]] | None = None,
) -> DataFrame:
    """(id, n_tokens long, ids binary[, decoded binary]): ids are packed little-endian unsigned 32-bit
    integers; decoded, if asked for, is made from these ids again. derive puts string columns in place of
    these two: by name, the column each is made from and the function of its bytes. It is called in the
    worker, so that neither ids nor texts go back through the executor's JVM."""
    need(df, id_col, text_col)
    shared = _share(df, vocabulary, pattern)
    kind = dict(df.dtypes)[id_col]
    whole = ("ids", "decoded") if with_decoded else ("ids",)
    if unknown := [c for c, _ in (derive or {}).values() if c not in whole]:
        raise ValueError(f"columns are derived from {whole}, not from {unknown}")
    made = [(c, c, None) for c in whole] if derive is None else [(name, c, f) for name, (c, f) in derive.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in pieces_of(batch, "text", PART_BYTES):
                ids = encoder.encode(texts(part))
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64())]
                for _, c, f in made:
                    values = map(encoder.decode, ids) if c == "decoded" else ids
                    columns.append(pa.array(map(f, values), pa.string()) if f else pa.array(values, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", *(name for name, _, _ in made)])

    schema = f"`{id_col}` {kind}, n_tokens long" + "".join(f", `{name}` {'string' if f else 'binary'}" for name, _, f in made)
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) from packed ids; null ids give no bytes."""
    need(df, id_col, ids_col)
    shared = _share(df, vocabulary, pattern)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value[0]
        for batch in batches:
            for part in pieces_of(batch, "ids"):
                whole = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary())], [id_col, "decoded"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
