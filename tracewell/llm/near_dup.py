"""N-gram Jaccard join by chosen paths.

A document's set holds its runs of `gram` words (a text with fewer words: all of them as one run); two
documents are linked if their sets' Jaccard similarity reaches the threshold. Classes are the connected
components of the links.

1. Documents with equal sets (copies) become one node, the smallest id; links are counted with copies.
2. Chosen paths: a run begins with one node of all documents. A node samples one coordinate of its members'
   signatures, sometimes two (1 / threshold on average), and its members split by the token they have
   there, so members with a shared sampled token stay together. Nodes of at most LIMIT members are
   compared pairwise by brute force on their signatures; larger ones are split again, up to DEPTH times (nodes of
   at most LOCAL members inside one task, larger ones by a shuffle). The runs are repeated until a pair at the
   threshold is found with the target probability, which follows from the branching.
3. Members of a node whose signatures are near, and whom such nearness connects, make a bucket; the same bucket of
   several runs is one. Nodes still over LIMIT members after DEPTH splits share DEPTH sampled tokens, so nearly all
   their pairs are links: nodes that overlap are joined to one bucket, which is dealt over tasks in tiles.
4. In each bucket pairs are checked exactly on the sets, in tiles of TILE by TILE documents, so no pairs are
   emitted: a tile gives a row for each of its documents, with its links counted. Every document brings the
   list of its buckets, and a pair counts only in the first bucket that both are in.

So work grows with the documents times the buckets that they are in, a bounded number of at most LIMIT members each,
and only groups of that many linked documents with different texts cost the square of their size (their links do, too).
Nothing is gathered on the driver, and large nodes, buckets and classes of copies are dealt over tasks. What is computed
once and read again is kept by the executors, each block by two of them; no file is made for it in a shared folder.

Defined results: a null or wordless text has the empty set, no links and a class of its own; a null id is
one document below all others; ids are cast to long; rows with one id are one document, whose text is the one of
least xxhash64, each row getting a row and counting as a link of its own; the least id names a class; an empty table gives an empty table. Ties
don't arise. Other columns of the input are not carried along by `classes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._common import by_place, cut_local, id_column, need, null_id_back, pieces_of, place_of, texts

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.995
COORDINATES = 64
#: Signatures estimate similarity with a deviation of 0.05 at 0.8; pairs this far below stay candidates.
MARGIN = 0.18
LIMIT = 128
DEPTH = 6
#: Nodes of so many members are split on inside one task, which holds their signatures (256 bytes each).
LOCAL = 1 << 15
#: Up to so many larger nodes, their names are broadcast.
BROADCAST_NODES = 500_000
#: A bucket is cut into blocks of so many documents, or so many items of their sets together.
TILE = 512
TILE_ITEMS = 1 << 20
SALTS = 32
PARTS = 8
#: Rows of one id that are made at once.
ROWS = 4_096
SLICE = 4_096
#: Tokens and columns counted at once.
RANGE_ITEMS = 1 << 19
COLUMNS = 2_048
_RANDOM = np.random.default_rng(40)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shares(threshold: float, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For a pair at the threshold: the probability of each number of equal coordinates in its signatures, and that of
    sharing a last node in one run, given that number. All runs sample the same coordinates."""
    equal = np.arange(COORDINATES + 1)
    weight = np.array([math.comb(COORDINATES, m) * threshold**m * (1 - threshold) ** (COORDINATES - m) for m in equal])
    share, two = np.ones(len(equal)), min(1.0, 1 / threshold - 1)
    for _ in range(depth):
        kept = equal / COORDINATES * share
        share = (1 - two) * kept + two * (1 - (1 - kept) ** 2)
    return weight, share


def recall_after(runs: int, threshold: float, depth: int) -> float:
    """The probability that a pair at the threshold has shared a last node after some runs."""
    weight, share = _shares(threshold, depth)
    return float((weight * (1 - (1 - share) ** runs)).sum())


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has shared a last node with probability `recall`."""
    weight, share = _shares(threshold, depth)
    if recall >= weight[share > 0].sum():
        raise ValueError(f"signatures of {COORDINATES} coordinates don't reach recall {recall} at {threshold}")
    runs = 1
    while (weight * (1 - (1 - share) ** runs)).sum() < recall:
        runs += 1
    return runs


def shingles(text: str, gram: int) -> np.ndarray:
    """The set as sorted 64-bit hashes."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([*map(xxhash.xxh3_64_intdigest, words)], np.uint64)
    n = max(1, len(h) - gram + 1)
    total = np.full(n, len(h) if len(h) < gram else gram, np.uint64)
    for j in range(min(gram, len(h))):
        total += h[j : j + n] * _PLACES[j]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return np.unique(total ^ (total >> np.uint64(35)))


def signature(items: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the items' hashes, 32 bits."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(items), SLICE):
        mixed = (items[i : i + SLICE, None] * _FACTORS + _OFFSETS) >> np.uint64(32)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, mark, p1, p2, items long, sig array<int>) of each row; mark is the text's hash, p1 and p2 the digest of the
    set, null if it is empty."""
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                sets = [shingles(t, gram) for t in texts(part)]
                empty = np.array([not len(s) for s in sets])
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                flat = np.concatenate([signature(s) for s in sets])
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(flat))
                items = pa.array([len(s) for s in sets], pa.int64())
                halves = [pa.array(prints[:, k], pa.int64(), mask=empty) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *halves, items, sigs], ["id", "mark", "p1", "p2", "items", "sig"])

    return _given(docs, id_col, text_col).mapInArrow(run, "id long, mark long, p1 long, p2 long, items long, sig array<int>")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_column(id_col).alias("id"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("text"))


def _children(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (node, id, sig) to (node, id): the nodes that each row goes on to."""
    step = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.lit(COORDINATES)).cast("int")
    second = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
    chosen = F.when(second & (step(1) != step(2)), F.array(step(1), step(2))).otherwise(F.array(step(1)))
    split = rows.withColumn("at", F.explode(chosen))
    return split.select(F.xxhash64("node", "at", F.element_at("sig", F.col("at") + 1)).alias("node"), "id")


def _stars(same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id that its links lead to."""
    root = ids.copy()
    while True:
        least = np.where(same, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(least, root)
        if (least == root).all():
            return root
        root = least


def _segments(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of sorted rows, cut so that rows with equal first columns come together."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        columns = [t.column(k).to_numpy() for k in range(keys)]
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        n = int(np.argmax(last))
        if n:
            yield t.slice(0, n).combine_chunks()
        held = t.slice(n)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    columns = [table.column(k).to_numpy() for k in range(keys)]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), table.num_rows)


def _hashed(code: int, n: int) -> int:
    return xxhash.xxh3_64_intdigest(code.to_bytes(8, "little"), seed=n)


def _chosen(code: int, threshold: float) -> list[int]:
    """The coordinates that a node splits by."""
    one, two = (_hashed(code, n) % COORDINATES for n in (1, 2))
    return [one, two] if one != two and _hashed(code, 3) % 1000 < int(1000 * (1 / threshold - 1)) else [one]


def _ends(sigs: np.ndarray, code: int, depth: int, threshold: float) -> Iterator[tuple[np.ndarray, bool]]:
    """The sets of members in which a node's paths end, and whether one is still large after so many splits."""
    todo, seen = [(np.arange(len(sigs)), code, depth)], set()
    while todo:
        rows, code, left = todo.pop()
        if len(rows) <= LIMIT or not left:
            key = xxhash.xxh3_128_digest(rows.tobytes())
            if key not in seen:
                seen.add(key)
                yield rows, len(rows) > LIMIT
            continue
        for at in _chosen(code, threshold):
            values = sigs[rows, at]
            order = np.argsort(values, kind="stable")
            starts = np.append(np.flatnonzero(np.diff(values[order], prepend=values[order[0]] ^ 1)), len(rows))
            several = np.flatnonzero(np.diff(starts) > 1)
            for a, b in zip(starts[several].tolist(), starts[several + 1].tolist(), strict=True):
                child = xxhash.xxh3_64_intdigest(f"{code},{at},{values[order[a]]}")
                todo.append((rows[order[a:b]], child, left - 1))


def _near(nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, bucket, large) from (node, depth, id, sig): the buckets of a node's members. A large one goes by its least id."""
    least = (threshold - MARGIN) * COORDINATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, 1):
            codes, depths, ids = (t.column(c).to_numpy() for c in ("node", "depth", "id"))
            sigs = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            out: list[tuple[np.ndarray, int, bool]] = []
            ends = _bounds(t, 1)
            size = np.diff(ends)
            two = ends[:-1][size == 2]
            pairs = np.sort(np.stack([ids[two], ids[two + 1]], axis=1)[(sigs[two] == sigs[two + 1]).sum(axis=1) >= least], axis=1)
            out += [(p, xxhash.xxh3_64_intdigest(p.tobytes()), False) for p in np.ascontiguousarray(pairs)]
            for a, n in zip(ends[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                order = np.argsort(ids[a : a + n])
                own, s = ids[a : a + n][order], sigs[a : a + n][order]
                for rows, large in _ends(s, int(codes[a]) & 0xFFFFFFFFFFFFFFFF, int(depths[a]), threshold):
                    if large:
                        out.append((own[rows], int(own[rows].min()), True))
                        continue
                    some = s[rows]
                    roots = _stars((some[:, None] == some[None]).sum(axis=2) >= least, own[rows])
                    for r in np.unique(roots[roots != own[rows]]).tolist():
                        members = own[rows[roots == r]]
                        out.append((members, xxhash.xxh3_64_intdigest(np.sort(members).tobytes()), False))
            lengths = [len(m) for m, _, _ in out]
            buckets = np.repeat(np.array([b & 0xFFFFFFFFFFFFFFFF for _, b, _ in out], np.uint64).view(np.int64), lengths)
            columns = [pa.array(np.concatenate([m for m, _, _ in out]) if out else [], pa.int64()), pa.array(buckets, pa.int64()), pa.array(np.repeat(np.array([x for _, _, x in out], bool), lengths), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "bucket", "large"])

    placed = nodes.repartition("node").sortWithinPartitions("node").select("node", "depth", "id", "sig")
    return placed.mapInArrow(run, "id long, bucket long, large boolean")


def buckets(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, bucket) over nodes (id, sig): what the chosen paths bring together."""
    n_runs = runs_needed(threshold, recall, DEPTH)
    rows = _children(nodes.select(F.explode(F.array(*(F.lit(r).cast("long") for r in range(n_runs)))).alias("node"), "id", "sig"), threshold)
    members, large = None, None
    for level in range(1, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("id").alias("least")).where("n > 1")
        sizes = cut_local(sizes)
        many = sizes.where(F.col("n") > LOCAL)
        n_many = many.count()
        # at most rows / LOCAL of them: what they hold is told apart on the map side
        named = F.broadcast(many.select("node", "least")) if n_many <= BROADCAST_NODES else many.select("node", "least")
        calm = rows.join(named.drop("least"), "node", "left_anti") if n_many else rows
        # runs bring the same documents together again and again: one node of each set of members is enough
        few = sizes.where(F.col("n") <= LOCAL).groupBy("n", "members").agg(F.min("node").alias("node"))
        found = calm.join(few.select("node", F.lit(DEPTH - level).alias("depth")), "node").select("node", "depth", "id")
        members = found if members is None else members.unionByName(found)
        if not n_many:
            break
        held = rows.join(named, "node")
        if level == DEPTH:
            large = held.select("id", F.col("least").alias("root"))
        else:
            rows = cut_local(_children(held.select("node", "id").join(nodes, "id").select("node", "id", "sig"), threshold))
    near = cut_local(_near(members.join(nodes, "id").select("node", "depth", "id", "sig"), threshold))
    stars = near.where("large").select("id", F.col("bucket").alias("root"))
    stars = (stars if large is None else stars.unionByName(large)).where("id <> root")
    found = near.where("not large").select("id", "bucket").distinct()
    if stars.isEmpty():
        return found
    return found.unionByName(components(stars).select("id", F.xxhash64("root", F.lit("large")).alias("bucket")))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in edges (id, root): the least id of its connected component. In each round a node
    takes the least label of its neighbours and of the node that its own label names, until none changes. The centre
    of a star, and the label of a large component, are met in PARTS parts."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int").alias("part")
    each = F.explode(F.array(*map(F.lit, range(PARTS)))).alias("at_part")
    both = edges.select(F.col("id").alias("a"), F.col("root").alias("b")).union(edges.select("root", "id")).distinct()
    both = cut_local(both.select("a", "b", part("a")))
    labels = cut_local(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"))
    while True:
        asks = both.unionByName(labels.select(F.col("id").alias("a"), F.col("root").alias("b"), part("id")))
        senders = labels.select(F.col("id").alias("sender"), F.col("root").alias("sent"), each)
        told = asks.join(senders, (asks["b"] == senders["sender"]) & (asks["part"] == senders["at_part"]))
        told = told.select(F.col("a").alias("id"), F.col("sent").alias("root"), F.lit(None).cast("long").alias("was"))
        new = labels.select("id", "root", F.col("root").alias("was")).unionByName(told)
        new = cut_local(new.groupBy("id").agg(F.min("root").alias("root"), F.max("was").alias("was")))
        labels = new.select("id", "root")
        if new.where("root <> was").isEmpty():
            return labels


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many tokens each of the first `left` sets shares with each of the others; left = all: among themselves.
    Counted by matrix products, over one range of the (sorted, evenly spread) tokens after the other."""
    total = sum(map(len, sets))
    right = 0 if left == len(sets) else left
    shared = np.zeros((left, len(sets) - right), np.float32)
    ranges = 1 << max(0, total // RANGE_ITEMS).bit_length()
    cuts = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - (ranges.bit_length() - 1))) if ranges > 1 else np.empty(0, np.uint64)
    at = [np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]]) for s in sets]
    for k in range(ranges):
        parts = [s[p[k] : p[k + 1]] for s, p in zip(sets, at, strict=True)]
        tokens, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = count > 1  # tokens of one set only meet nothing
        good = several[place]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in parts])[good]
        column = (np.cumsum(several) - 1)[place[good]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = int(several.sum())
        for first in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            held = np.zeros((len(sets), min(COLUMNS, width - first)), np.float32)
            held[owner[a:b], column[a:b] - first] = 1
            shared += held[:left] @ held[right:].T
    return shared


def _links(sets: list[np.ndarray], left: int, threshold: float) -> np.ndarray:
    """Which of the first `left` sets are linked with which of the others; left = all: among themselves."""
    n, shared = np.array([len(s) for s in sets], np.int64), _shared(sets, left)
    union = n[:left, None] + n[None, 0 if left == len(sets) else left :] - shared
    return shared >= threshold * union - 1e-6


def exact_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, gram: int, threshold: float) -> DataFrame:
    """(id, links long, root long) for each tile and document in it: the copies of the documents linked
    with it there, and the least id that links in the tile lead to. members: (id, mark, copies, items, bucket)."""
    blocks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("items") / TILE_ITEMS)).cast("int")
    # only buckets of several blocks are large, and met in parts
    large = members.groupBy("bucket").agg(blocks.alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    placed = members.withColumn("salt", salt).join(large, ["bucket", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.groupBy("id", "mark", "copies").agg(F.collect_list(F.struct("bucket", "blocks")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                packed = pa.array([shingles(t, gram).tobytes() for t in texts(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed], ["id", "copies", "at", "items"])

    given = _given(docs, id_col, text_col).join(placed, ["id", "mark"]).dropDuplicates(["id", "mark"])
    sets = given.select("id", "copies", "at", "text").mapInArrow(pack, "id long, copies long, at array<struct<bucket:long,blocks:int>>, items binary")
    each = sets.select("id", "copies", "items", F.array_sort("at.bucket").alias("all"), F.explode("at").alias("p"))
    each = each.select("id", "copies", "items", "all", "p.bucket", "p.blocks", F.pmod(F.xxhash64("id", "p.bucket"), F.col("p.blocks")).cast("int").alias("block"))
    tiles = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "all", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _segments(batches, 3):
            ends, out = _bounds(t, 3), []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out.append(_tile(t.slice(a, b - a), threshold))
            ids, links, roots = (np.concatenate([x[k] for x in out]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(roots, pa.int64())], ["id", "links", "root"])

    ordered = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "id")
    return ordered.mapInArrow(run, "id long, links long, root long")


def _tile(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, copies, block = (t.column(c).to_numpy() for c in ("id", "copies", "block"))
    bucket, i, j = (t.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    left = int((block == i).sum())
    if left == 0 or (i != j and left == len(ids)):
        return ids[:0], copies[:0], ids[:0]
    same = _links([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")], left, threshold)
    # pairs that both stand in an earlier bucket are counted there
    earlier = [x[x < bucket] for x in (np.array(a, np.int64) for a in t.column("all").to_pylist())]
    same &= _shared([(x.view(np.uint64) ^ np.uint64(1 << 63)) for x in earlier], left) < 0.5
    if i == j:
        np.fill_diagonal(same, False)
        return ids, same @ copies, _stars(same, ids)
    full = np.zeros((len(ids), len(ids)), bool)
    full[:left, left:] = same
    full |= full.T
    return ids, full @ copies, _stars(full, ids)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id long, n_links long, n_copies long) of each row: the least id of its class, the other
    documents linked with it, and how many of these have the same set."""
    if not 0.5 < threshold < 1:
        raise ValueError("threshold must lie between 0.5 and 1")
    found = cut_local(signatures(docs, id_col, text_col, gram))
    own = found.groupBy("id").agg(F.count("*").alias("times"), F.min("mark").alias("mark"), F.min_by("p1", "mark").alias("p1"), F.min_by("p2", "mark").alias("p2"))
    own = cut_local(own)
    heads = cut_local(own.where("p1 is not null").groupBy("p1", "p2").agg(F.min("id").alias("id"), F.min_by("mark", "id").alias("mark"), F.sum("times").alias("copies")))
    same = ["id", "mark"]
    nodes = cut_local(found.join(heads.select(*same, "copies"), same).dropDuplicates(same).select(*same, "items", "copies", "sig"))
    at = buckets(nodes.select("id", "sig"), threshold, recall)
    members = cut_local(at.join(nodes.drop("sig"), "id"))
    links = cut_local(exact_links(docs, members, id_col, text_col, gram, threshold))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(links.where("id != root").select("id", "root"))
    known = counted.join(named, "id", "left").select(F.col("id").alias("node"), "links", F.coalesce("root", "id").alias("root"))
    # a class of copies may hold a third of all rows: what is known of it is met in parts
    known = heads.select("p1", "p2", F.col("id").alias("node"), "copies").join(known, "node", "left").where("copies > 1 or links is not null")
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = known.withColumn("salt", F.explode(salts))
    several = known.where("copies > 1").select("p1", "p2", F.pmod("salt", F.lit(SALTS)).cast("int").alias("salt"), "node", "copies", "links", "root")
    single = known.where("copies = 1").select(F.col("node").alias("id"), F.col("links").alias("own_links"), F.col("root").alias("own_root"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    out = own.withColumn("salt", salt).join(several, ["p1", "p2", "salt"], "left").join(single, "id", "left")
    others = F.coalesce(F.col("copies") - 1, F.lit(0))
    class_id = F.coalesce("own_root", "root", "node", "id")
    out = out.select("id", "times", class_id.alias("class_id"), (F.coalesce("own_links", "links", F.lit(0)) + others).alias("n_links"), others.alias("n_copies"))
    # one id (null, say) may stand in a third of all rows: its rows are made in parts, dealt over tasks
    once = out.withColumn("n", F.col("times").cast("int")).where(F.col("times") <= ROWS)
    parts = out.where(F.col("times") > ROWS).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("times") - 1) / ROWS).cast("int"))))
    parts = parts.repartition("id", "part").withColumn("n", F.least(F.lit(ROWS), F.col("times") - F.col("part") * ROWS).cast("int")).drop("part")
    out = once.unionByName(parts).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(null_id_back(F.col("id")).alias(id_col), null_id_back(F.col("class_id")).alias("class_id"), "n_links", "n_copies")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, without the documents that aren't their class's least id."""
    found = classes(docs, id_col, text_col, **options)
    later = found.where(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("id")).distinct()
    placed, _ = by_place(docs)
    return placed.join(later, placed[place_of(docs, id_col)].eqNullSafe(later["id"]), "left_anti").toDF(*docs.columns)
