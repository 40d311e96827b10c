"""Approximate nearest neighbours by cosine: inverted lists scanned with adaptively many dimensions.

The index is fitted on a bounded sample (SAMPLE vectors, those first by a hash of the id): centroids of
the lists, a random rotation, and how many lists a query must probe for the wanted recall, measured by
brute force within the sample. Every row is indexed. Lists grow with the root of the rows: there are up to TOP_LISTS
centroids of vectors, and, where more lists are wanted, centroids of what these leave over, so that a list
goes by a pair of centroids and all pairs of two small tables make as many lists as it takes.

In a probed list the rotated unit vectors lie in column blocks; after each block a hypothesis test on the partial
distance, scaled up to all dimensions, abandons the candidates that are almost surely farther than the k-th
best so far (rotation makes any block of dimensions a fair sample). What is left is scored exactly, in double
precision on the original vectors, and every STEP candidates the k-th best found tightens the bound. A list's
candidates that are among SEEDS vectors of the sample are scanned first, when a query chooses its lists: the
k best of them are its first finds and give its first bound. Seeds in lists that a query doesn't probe don't
count. A query whose lists hold fewer than k vectors is asked again of all lists.

A list may hold a third of all rows, and be probed by a third of all queries: lists are cut into parts of
about PART_ROWS candidates and PART_QUERIES queries, and every pair of parts is scanned by itself.

Defined results: vectors that are null, zero, of another than the usual length (the most frequent, the
least of equals), or hold a null or non-finite component take no part; null ids take none either; ids are cast to
long; rows with one id count once, with the best of their scores, the query's own id never; ties go to the smaller
id; an empty table gives an empty table. Other columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._common import cut, need

SAMPLE = 16_384
SEEDS = 512
PART_ROWS = 8_192
PART_QUERIES = 8_192
#: Centroids of the first level; each needs 8 vectors of the sample.
TOP_LISTS = 2_048
#: Up to so many lists, a table of their parts is broadcast.
BROADCAST_LISTS = 100_000
COLUMN_BLOCK = 16
#: Candidates that a query scans before its bound is tightened.
STEP = 1_024
#: Ranks of lists worked out at once, over all queries of a batch.
RANKS = 1 << 21
#: How many deviations off a partial distance may be before its candidate is given up.
DEVIATIONS = 2.1
SLACK = 1e-4


@dataclass
class Lists:
    """A list for each pair of a centroid (unit vectors) and a centroid of what is left over (one, zero, if a level is enough)."""

    tops: np.ndarray
    rests: np.ndarray

    def __len__(self) -> int:
        return len(self.tops) * len(self.rests)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The list of each unit vector."""
        top = (x @ self.tops.T).argmax(axis=1)
        if len(self.rests) == 1:
            return top.astype(np.int32)
        left = x - self.tops[top]
        rest = ((self.rests * self.rests).sum(axis=1) - 2 * left @ self.rests.T).argmin(axis=1)
        return (top * len(self.rests) + rest).astype(np.int32)

    def far(self, q: np.ndarray) -> np.ndarray:
        """(queries, lists): squared distances to the lists' places, less a constant of the query."""
        own = (self.rests * self.rests).sum(axis=1) - 2 * q @ self.rests.T
        both = 2 * self.tops @ self.rests.T
        return (both[None] + (-2 * q @ self.tops.T)[:, :, None] + own[:, None, :]).reshape(len(q), -1)


@dataclass
class Index:
    dim: int
    lists: Lists
    rotation: np.ndarray
    probes: int
    seed_ids: np.ndarray
    seeds: np.ndarray  # original vectors, in double precision
    seed_lists: np.ndarray


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector; those, in double precision."""
    long = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    good = long.to_numpy(zero_copy_only=False).astype(bool)
    flat = column.filter(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    good[good] = fine
    return good, x[fine]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _k_means(x: np.ndarray, k: int, rounds: int = 8, unit: bool = True) -> np.ndarray:
    random = np.random.default_rng(5)
    centroids = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ centroids.T - (0 if unit else 0.5 * (centroids * centroids).sum(axis=1))).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True)) if unit else np.bincount(own, minlength=len(centroids))[:, None]
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-12), centroids).astype(np.float32)
    return np.unique(centroids, axis=0)


def _lists(x: np.ndarray, wanted: int) -> Lists:
    tops = _k_means(x, min(wanted, TOP_LISTS, max(1, len(x) // 8)))
    per = -(-wanted // len(tops)) if wanted > len(tops) == TOP_LISTS else 1
    if per == 1:
        return Lists(tops, np.zeros((1, x.shape[1]), np.float32))
    left = x - tops[(x @ tops.T).argmax(axis=1)]
    return Lists(tops, _k_means(left, min(per, max(1, len(x) // 8)), unit=False))


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.97) -> Index | None:
    """None if there is no usable vector."""
    need(df, id_col, vector_col)
    rows = df.where(df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return None
    dim = common["n"]
    taken = rows.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    good, x = _vectors(taken["v"].combine_chunks(), dim)
    ids, first = np.unique(taken["id"].to_numpy()[good], return_index=True)
    given = x[first]
    if not len(given):
        return None
    x = _unit(given)
    lists = _lists(x, max(1, int(np.sqrt(rows.count()) / 4)))
    # lists to probe: over sample queries and their nearest in the sample, the place of the neighbour's list
    ask = np.random.default_rng(6).permutation(len(x))[:256]
    near = x[ask] @ x.T
    near[np.arange(len(ask)), ask] = -2
    nearest = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    own, places = lists.of(x), []
    for i in range(len(ask)):
        far = lists.far(x[ask[i : i + 1]])[0]
        places += np.searchsorted(np.sort(far), far[own[nearest[i]]], "right").tolist()
    places.sort()
    probes = places[min(len(places) - 1, int(np.ceil(recall * len(places))))] if places else 1
    rotation = np.linalg.qr(np.random.default_rng(8).normal(size=(dim, dim)))[0].astype(np.float32)
    some = np.random.default_rng(9).permutation(len(ids))[:SEEDS]
    return Index(dim, lists, rotation, probes, ids[some], given[some], own[some])


def column_blocks(rotated: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(rotated[:, i : i + COLUMN_BLOCK]) for i in range(0, rotated.shape[1], COLUMN_BLOCK)]


def scan(blocks: list[np.ndarray], query: list[np.ndarray], bound: float) -> np.ndarray:
    """Rows of rotated vectors, in column blocks, whose squared distance from a query's may be within the
    bound: all but those that a test on their first dimensions gave up."""
    dim, seen = sum(len(q) for q in query), 0
    alive, so_far = np.arange(len(blocks[0])), np.zeros(len(blocks[0]), np.float32)
    for block, part in zip(blocks, query, strict=True):
        gap = (block if seen == 0 else block[alive]) - part
        so_far = so_far + np.einsum("ij,ij->i", gap, gap)
        seen += len(part)
        limit = bound + SLACK if seen == dim else bound * seen / dim * (1 + DEVIATIONS / np.sqrt(seen)) ** 2 + SLACK
        keep = so_far <= limit
        alive, so_far = alive[keep], so_far[keep]
    return alive


def nearest_of(ids: np.ndarray, x: np.ndarray, norms: np.ndarray, blocks: list[np.ndarray], own: int, q: np.ndarray, query: list[np.ndarray], bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a query's k nearest among candidates (original vectors, their norms, rotated column
    blocks), but for those that the test on partial distances gave up; every STEP of them tighten the bound."""
    found, scores = ids[:0], norms[:0]
    size = np.sqrt((q * q).sum())
    for start in range(0, len(ids), STEP):
        left = scan([b[start : start + STEP] for b in blocks], query, bound) + start
        left = left[ids[left] != own]
        if not len(left):
            continue
        found = np.append(found, ids[left])
        scores = np.append(scores, (x[left] * q).sum(axis=1) / (norms[left] * size))
        best = np.lexsort((found, -scores))[:k]
        found, scores = found[best], scores[best]
        if len(best) == k:
            bound = min(bound, 2 - 2 * scores[-1])
    return found, scores


def search(df: DataFrame, index: Index | None, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for each row of df that is_query holds for, the
    k nearest found among the other rows."""
    need(df, id_col, vector_col)
    out_schema = "query_id long, vec_id long, score double"
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = df.sparkSession.sparkContext.broadcast(index)
    kind = dict(df.dtypes)[vector_col]
    together = max(1, min(64, RANKS // len(index.lists)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _vectors(batch.column(1), shared.value.dim)
            kept = batch.filter(pa.array(good))
            if len(x):
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shared.value.lists.of(_unit(x)))], ["id", "v", "asks", "list"])

    def chosen(batches: Iterator[pa.RecordBatch]):
        """Parts of queries; their lists; the seeds in these by nearness; scores; which of them count (not the query itself)."""
        ix = shared.value
        sizes = np.sqrt((ix.seeds * ix.seeds).sum(axis=1))
        for batch in batches:
            for start in range(0, batch.num_rows, together):
                part = batch.slice(start, together)
                x = _vectors(part.column(1), ix.dim)[1]
                far = ix.lists.far(_unit(x))
                n = min(ix.probes, far.shape[1])
                lists = np.argpartition(far, n - 1, axis=1)[:, :n].astype(np.int32)
                probed = np.zeros(far.shape, bool)
                np.put_along_axis(probed, lists.astype(np.int64), True, 1)
                score = np.stack([(ix.seeds * q).sum(axis=1) for q in x]) / (sizes * np.sqrt((x * x).sum(axis=1))[:, None])
                score[(part.column(0).to_numpy()[:, None] == ix.seed_ids) | ~probed[:, ix.seed_lists]] = -2
                order = np.lexsort((np.broadcast_to(ix.seed_ids, score.shape), -score))[:, :k]
                score = np.take_along_axis(score, order, 1)
                yield part, lists, order, score, score > -1.5

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists, _, score, counts in chosen(batches):
            full = counts.sum(axis=1) == k
            bounds = np.where(full, 2 - 2 * np.where(full, score[:, -1], 0), 4.0) if score.shape[1] else np.full(part.num_rows, 4.0)
            rows = np.repeat(np.arange(part.num_rows), lists.shape[1])
            took = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(bounds[rows]), pa.array(lists.ravel())], ["id", "v", "bound", "list"])

    def first_finds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, order, score, counts in chosen(batches):
            ids = np.repeat(part.column(0).to_numpy(), counts.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shared.value.seed_ids[order[counts]]), pa.array(score[counts])], ["query_id", "vec_id", "score"])

    def nearest(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        ix = shared.value
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if candidates.num_rows and queries.num_rows:
            ids, x = candidates.column("id").to_numpy(), _vectors(candidates.column("v").combine_chunks(), ix.dim)[1]
            _, first = np.unique(np.column_stack([ids.astype(np.float64), x]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (None, np.arange(len(ids)))
            ids, x = ids[first], x[first]
            q = _vectors(queries.column("v").combine_chunks(), ix.dim)[1]
            blocks, asked = column_blocks(_unit(x) @ ix.rotation), column_blocks(_unit(q) @ ix.rotation)
            norms = np.sqrt((x * x).sum(axis=1))
            for i, (qid, bound) in enumerate(zip(queries.column("id").to_pylist(), queries.column("bound").to_pylist(), strict=True)):
                found.append((qid, *nearest_of(ids, x, norms, blocks, qid, q[i], [a[i] for a in asked], bound, k)))
        asked_ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
        near_ids, scores = (np.concatenate([f[j] for f in found]) if found else np.empty(0) for j in (1, 2))
        return pa.table({"query_id": pa.array(asked_ids, pa.int64()), "vec_id": pa.array(near_ids.astype(np.int64)), "score": pa.array(scores.astype(np.float64))})

    given = df.where(df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(given.mapInArrow(assign, f"id long, v {kind}, asks boolean, list int"))
    queries = cut(rows.where("asks").select("id", "v").dropDuplicates(["id"]))

    def scanned(asked: DataFrame) -> DataFrame:
        # one row a list: into how many parts it is cut
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("c_parts"))
        asks = asked.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("q_parts"))
        parts = cut(sizes.join(asks, "list"))
        parts = F.broadcast(parts) if len(index.lists) <= BROADCAST_LISTS else parts
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        candidates = rows.join(parts, "list").select("list", part(F.col("c_parts")).alias("c"), each("q_parts").alias("q"), "id", "v")
        probing = asked.join(parts, "list").select("list", each("c_parts").alias("c"), part(F.col("q_parts")).alias("q"), "id", "v", "bound")
        keys = ("list", "c", "q")
        return candidates.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(nearest, out_schema)

    found = scanned(queries.mapInArrow(probe, f"id long, v {kind}, bound double, list int")).unionByName(queries.mapInArrow(first_finds, out_schema))
    found = cut(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = cut(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"))
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0), F.lit(len(index.lists) - 1))).alias("list")
        found = found.unionByName(scanned(short.select(F.col("id").alias("id"), F.col("v").alias("v"), F.lit(4.0).alias("bound"), every)))
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
