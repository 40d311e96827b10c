"""Substring dedup by seeds and extension.

A repeat is a run of words, at least `length` of them, each of whose windows of `length` words also starts
in a document with a smaller id; the words of repeats are removed, all judged on the input.

Seeds. Of the grams (of `gram` words) in a window, the window's anchor is the one of least hash, the
leftmost of equals; equal windows have equal anchors, and a document has about 2 / (length - gram + 2)
anchors a word. Documents are dealt into buckets by hash; a bucket sends the set of its anchors, and gets
back those that another bucket has too (documents are joined on anchors without making pairs of them).
Extension. A match of two documents at an anchor is extended both ways, by the words before and after it, as far
as the documents agree. All matches at an anchor are extended at once, without pairs: wherever two documents agree
on `length` words around it, they have one of the windows in common for which the anchor stands, with the anchor at the
same offset, and the whole match is the run of these windows. So each document extends its shared anchors to
those windows; their 96-bit hashes go out with the least id that has them in the bucket, and those come back, in
full, of which another bucket has a smaller id. Windows repeated inside a bucket need no exchange. Each document
then joins its repeated windows to maximal runs, which are the matches with any smaller document, joined.

Sets are exchanged packed, a row for each bucket and shard of the hash space, so that a hash that
stands in a third of all documents crosses once a bucket. Buckets hold about BUCKET_BYTES of text, or one
document. Texts are shuffled once, by bucket.

Defined results: a null text has no words; a null id is below every other; ids are cast to long; rows with one id are one
document (none of them is smaller than another); texts of fewer than `length` words lose nothing; an empty
table gives an empty table; other columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._common import id_column, need, null_id_back

LENGTH = 13
GRAM = 5
BUCKET_BYTES = 4 << 20
MIN_BUCKETS = 64
_MULTIPLIERS = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(words: np.ndarray, n: int, lane: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total += words[j : j + count] * _MULTIPLIERS[(lane * 67 + j) % 256]
    return _mixed(total)


class Laid:
    """Documents' words as hashes, laid end to end, and the windows that lie in one document each."""

    def __init__(self, documents: Iterable[tuple[int, list[bytes]]], length: int):
        ids, parts = [], []
        for i, words in documents:
            ids.append(i)
            parts.append(np.array([*map(xxhash.xxh3_64_intdigest, words)], np.uint64))
        self.length, self.words = length, np.concatenate(parts) if parts else np.empty(0, np.uint64)
        n = np.array([len(p) for p in parts], np.int64)
        #: Windows of each document, and where all windows begin.
        self.counts = np.maximum(n - length + 1, 0)
        before = np.cumsum(n) - n - (np.cumsum(self.counts) - self.counts)
        self.starts = np.repeat(before, self.counts) + np.arange(self.counts.sum())
        self.ids = np.repeat(np.array(ids, np.int64), self.counts)

    def anchors(self, gram: int) -> np.ndarray:
        """Of each window the least hash of a gram."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        grams = _runs(self.words, gram, 0)
        n = len(self.words) - self.length + 1
        best = grams[:n].copy()
        for j in range(1, self.length - gram + 1):
            np.minimum(best, grams[j : j + n], out=best)
        return best[self.starts]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window 64 bits and 32 more."""
        if not len(self.starts):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        checks = (_runs(self.words, self.length, 2)[self.starts] >> np.uint64(32)).astype(np.uint32)
        return _runs(self.words, self.length, 1)[self.starts], checks


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that sorted hashes fall into, and where each begins, with the end."""
    shard = (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    found, starts = np.unique(shard, return_index=True)
    return found.astype(np.int64), np.append(starts, len(hashes))


def _packed(bucket: int, hashes: np.ndarray, shards: int, **more: np.ndarray) -> pa.Table:
    found, ends = _by_shard(hashes, shards)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return pa.table({"shard": pa.array(found, pa.int64()), "b": pa.array(np.full(len(found), bucket), pa.int64()), "hashes": cut(hashes), **{k: cut(v) for k, v in more.items()}})


def _unpacked(column: Iterable, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _held(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x stand in a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(among, x), len(among) - 1)
    return among[at] == x


def _held_pairs(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which pairs of x and y stand in hashes and checks, sorted by hash."""
    found = np.zeros(len(x), bool)
    at = np.searchsorted(hashes, x)
    open_ = np.flatnonzero(at < len(hashes))
    while len(open_):  # once more for each further check of a hash
        open_ = open_[hashes[at[open_]] == x[open_]]
        found[open_] |= checks[at[open_]] == y[open_]
        at[open_] += 1
        open_ = open_[~found[open_] & (at[open_] < len(hashes))]
    return found


def _first_ids(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash and check; where each group begins in it; the least id of each group."""
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    return order, starts, np.minimum.reduceat(ids[order], starts) if len(starts) else ids[:0]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_words long, n_removed long, kept string, repeats array<struct<start int, end int>>) of each row:
    kept are the words that stay, joined by one space; repeats are the maximal runs, in places of words."""
    need(docs, id_col, text_col)
    if not 1 <= gram <= length <= 67:
        raise ValueError("1 <= gram <= length <= 67")
    total = docs.select(F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0))).first()[0]
    shards = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))
    given = docs.select(id_column(id_col).alias("id"), docs[text_col].alias("text"))
    # texts without a byte may be many under one id (null, say): they are dealt by where they stand
    place = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, F.spark_partition_id())
    given = given.withColumn("b", F.pmod(F.xxhash64("id", "text", place), F.lit(shards)))
    given = given.repartition(shards, "b")  # as many tasks as buckets, whatever the session's setting

    def words_of(table: pa.Table) -> Iterable[tuple[int, list[bytes]]]:
        for batch in table.to_batches(max_chunksize=256):
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield i, (t or "").encode().split()

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        return _packed(key[0].as_py(), np.unique(Laid(words_of(table), length).anchors(gram)), shards)

    def return_anchors(key: tuple, table: pa.Table) -> pa.Table:
        parts = _unpacked(table.column("hashes"), np.uint64)
        _, place, count = np.unique(_joined(parts), return_inverse=True, return_counts=True)
        shared, at, out = count[place] > 1, 0, []
        for p in parts:
            out.append(p[shared[at : at + len(p)]].tobytes())
            at += len(p)
        return pa.table({"b": table.column("b"), "hashes": pa.array(out, pa.binary())})

    def send_windows(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        shared = np.sort(_joined(_unpacked(back.column("hashes"), np.uint64)))
        laid = Laid(words_of(table) if len(shared) else (), length)
        good = _held(laid.anchors(gram), shared)
        h, c = (x[good] for x in laid.hashes())
        order, starts, first = _first_ids(h, c, laid.ids[good])
        return _packed(key[0].as_py(), h[order][starts], shards, checks=c[order][starts], ids=first)

    def return_windows(key: tuple, table: pa.Table) -> pa.Table:
        parts = _unpacked(table.column("hashes"), np.uint64)
        h, c = _joined(parts), _joined(_unpacked(table.column("checks"), np.uint32), np.uint32)
        i = _joined(_unpacked(table.column("ids"), np.int64), np.int64)
        order, starts, first = _first_ids(h, c, i)
        later = np.empty(len(h), bool)
        later[order] = i[order] > np.repeat(first, np.diff(np.append(starts, len(h))))
        at, out = 0, []
        for p in parts:
            good = later[at : at + len(p)]
            out.append((p[good].tobytes(), c[at : at + len(p)][good].tobytes()))
            at += len(p)
        return pa.table({"b": table.column("b"), **{n: pa.array([x[k] for x in out], pa.binary()) for k, n in enumerate(("hashes", "checks"))}})

    def remove(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        elsewhere, their_checks = _joined(_unpacked(back.column("hashes"), np.uint64)), _joined(_unpacked(back.column("checks"), np.uint32), np.uint32)
        order = np.argsort(elsewhere, kind="stable")
        elsewhere, their_checks = elsewhere[order], their_checks[order]
        laid = Laid(words_of(table), length)
        (h, c), ids, counts = laid.hashes(), laid.ids, laid.counts.tolist()
        order, starts, first = _first_ids(h, c, ids)
        repeated = np.empty(len(h), bool)
        repeated[order] = ids[order] > np.repeat(first, np.diff(np.append(starts, len(h))))
        repeated |= _held_pairs(h, c, elsewhere, their_checks)
        n_words, n_removed, kept, at, begins, ends, offsets = [], [], [], 0, [], [], [0]
        for n, (_, words) in zip(counts, words_of(table), strict=True):
            own = np.flatnonzero(repeated[at : at + n])
            at += n
            if not len(own):
                offsets.append(offsets[-1])
                n_words.append(len(words))
                n_removed.append(0)
                kept.append(b" ".join(words).decode())
                continue
            over = np.zeros(len(words) + 1, np.int32)
            over[own] += 1
            over[own + length] -= 1
            gone = np.append(np.cumsum(over)[:-1] > 0, False)
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
            begins.append(edges[::2])
            ends.append(edges[1::2])
            offsets.append(offsets[-1] + len(edges) // 2)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
        spans = pa.StructArray.from_arrays([pa.array(_joined(x, np.int64), pa.int32()) for x in (begins, ends)], ["start", "end"])
        return pa.table({"id": table.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "repeats": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)})

    buckets = given.groupBy("b")
    seeds = buckets.applyInArrow(send_anchors, "shard long, b long, hashes binary")
    shared = seeds.repartition(shards, "shard").groupBy("shard").applyInArrow(return_anchors, "b long, hashes binary")
    windows = buckets.cogroup(shared.groupBy("b")).applyInArrow(send_windows, "shard long, b long, hashes binary, checks binary, ids binary")
    later = windows.repartition(shards, "shard").groupBy("shard").applyInArrow(return_windows, "b long, hashes binary, checks binary")
    out = buckets.cogroup(later.groupBy("b")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string, repeats array<struct<start:int,end:int>>")
    return out.select(null_id_back(F.col("id")).alias(id_col), "n_words", "n_removed", "kept", "repeats")
