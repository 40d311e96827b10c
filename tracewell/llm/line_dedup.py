"""Line dedup with exact reference counts behind sharded cuckoo filters.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Keys of at
least min_chars code points that stand in at least min_docs documents lose all their lines except in
the document with the largest id that holds them.

The reference table holds (key, document, row, number of such lines), exactly; keys are 128-bit digests, and
row is the hash of the row's text, so that not even the rows of one id are gathered. The keys with enough documents
are also held in cuckoo filters, one for each shard of the key space, of 16-bit fingerprints. A filter only sorts
out the references that can't be of such a key: on the map side if all filters together are small enough to
broadcast, else each shard's references meet its filter, in SALTS parts. What passes is verified against the
reference table. Since references are counted, and a cuckoo filter can forget a key, a batch of documents can be
inserted or deleted: both are changes of counts, which change the filters of the shards they touch. `deduplicated`
inserts all documents as the first batch, and the executors keep both tables, each block on the disks of two of them;
LineIndex keeps them in a shared folder over many batches.

Defined results: a null or empty text is one empty line; a null id is one document, below all others; ids are cast
to long; rows with the same id are one document, each row keeping its own lines; ties don't arise, as only ids
are compared; an empty table gives an empty table. Other columns of the input are carried along; of those named
like a result (n_lines, n_dropped, kept) `deduplicated` keeps the result, `with_kept_text` the input's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm._common import ASCII_SPACE, by_place, cut, cut_local, id_column, need, pieces_of, place_of, texts

MIN_CHARS = 40
MIN_DOCS = 5
#: Filters of all shards together are broadcast up to this size; beyond it references are shuffled to them.
BROADCAST_BYTES = 32 << 20
KEYS_A_SHARD = 1 << 17
#: After so many batches an index writes its whole reference table anew.
BATCHES = 8
#: A key may hold a third of all rows; its references are joined in so many parts.
SALTS = 32


def line_key(line: str, min_chars: int) -> bytes | None:
    """The digest of a line's key, None if the key is too short."""
    key = line.strip(ASCII_SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's two buckets differ by its fingerprint's hash."""

    SLOTS = 4
    MAX_KICKS = 500

    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        n = 1 << max(3, int(np.ceil(capacity / (self.SLOTS * 0.85))) - 1).bit_length()
        self.cells = np.zeros((n, self.SLOTS), np.uint16) if cells is None else cells
        self.mask = np.uint64(len(self.cells) - 1)

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def blob(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """digests: (n, 2) of uint64. Fingerprints and both buckets."""
        prints = ((digests[:, 1] >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = digests[:, 0] & self.mask
        return prints, first, first ^ self._step(prints)

    def _step(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3) & self.mask

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(digests)
        return ((self.cells[first] == prints[:, None]) | (self.cells[second] == prints[:, None])).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """False if it is full; it must then be built anew, larger."""
        random = np.random.default_rng(7)
        for p, a, b in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for at in (a, b):
                free = np.flatnonzero(self.cells[at] == 0)
                if free.size:
                    self.cells[at, free[0]] = p
                    break
            else:
                at = b
                for _ in range(self.MAX_KICKS):
                    slot = int(random.integers(self.SLOTS))
                    p, self.cells[at, slot] = int(self.cells[at, slot]), p
                    at = int(np.uint64(at) ^ self._step(np.array([p], np.uint16))[0])
                    free = np.flatnonzero(self.cells[at] == 0)
                    if free.size:
                        self.cells[at, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, digests: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(digests)), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.cells[at] == p)
                if held.size:
                    self.cells[at, held[0]] = 0
                    break


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _shard(n: int):
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")


def _salt():
    return F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int")


def _built(keys: list[bytes], capacity: int = 0) -> CuckooFilter:
    size = max(capacity, len(keys))
    while not (f := CuckooFilter(size)).insert(_digests(keys)):
        size *= 2
    return f


def reference_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key binary, id long, row long, lines long): how many lines with the key the rows of a document with that text have."""
    need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                keys, counts, distinct = [], [], []
                for text in texts(part):
                    seen: dict[bytes, int] = {}
                    for line in text.split("\n"):
                        if len(line) >= min_chars and (k := line_key(line, min_chars)):
                            seen[k] = seen.get(k, 0) + 1
                    keys += seen
                    counts += seen.values()
                    distinct.append(len(seen))
                own = pa.array(np.repeat(np.arange(len(distinct)), distinct))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), part.column(0).take(own), part.column(1).take(own), pa.array(counts, pa.int64())], ["key", "id", "row", "lines"])

    found = docs.select(id_column(id_col).alias("id"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].alias("text")).mapInArrow(run, "key binary, id long, row long, lines long")
    return found.groupBy("key", "id", "row").agg(F.sum("lines").alias("lines"))


def repeated(refs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, n_docs, keeper): the keys of enough documents and the largest id that holds each."""
    once = refs.select("key", "id").distinct()
    return once.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def changed_filters(changes: DataFrame, filters: DataFrame, shards: int, room: int = 1) -> DataFrame:
    """(shard int, blob binary): filters (shard, blob) after changes (key, change 1 or -1), for each shard that either
    has. New filters have room for so many times their keys; one too full for its new keys is empty bytes."""

    def update(key: tuple, change: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        gone, new = ([*change["key"][change["change"] == x]] for x in (-1, 1))
        if not len(held):
            return pd.DataFrame({"shard": [key[0]], "blob": [_built(new, room * max(16, len(new))).blob()]})
        f = CuckooFilter.read(held["blob"].iloc[0])
        if gone:
            f.delete(_digests(gone))
        full = bool(new) and not f.insert(_digests(new))
        return pd.DataFrame({"shard": [key[0]], "blob": [b"" if full else f.blob()]})

    return changes.withColumn("shard", _shard(shards)).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(update, "shard int, blob binary")


def _no_filters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "shard int, blob binary")


def _inserted(hot: DataFrame) -> DataFrame:
    return hot.select("key", F.lit(1).alias("change"))


def passing(refs: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(key, id, row): the references that a filter may hold."""
    size = filters.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0]
    given = refs.select("key", "id", "row", _shard(shards).alias("shard"))
    if size > BROADCAST_BYTES:
        return _passing_by_shard(given, filters)
    blobs = refs.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in filters.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: CuckooFilter.read(b) for s, b in blobs.value.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(3).to_numpy(zero_copy_only=False)
            digests, good = _digests(batch.column(0).to_pylist()), np.zeros(batch.num_rows, bool)
            for s in np.unique(shard):
                if s in held:
                    rows = np.flatnonzero(shard == s)
                    good[rows] = held[s].contains(digests[rows])
            yield batch.select([0, 1, 2]).filter(pa.array(good))

    return given.mapInArrow(run, "key binary, id long, row long")


def _passing_by_shard(given: DataFrame, filters: DataFrame) -> DataFrame:
    """The same by a shuffle of both sides. A shard's references come in SALTS parts, after a copy of its filter."""
    none = [F.lit(None).cast(k).alias(n) for n, k in (("key", "binary"), ("id", "long"), ("row", "long"))]
    sides = filters.select(*none, "shard", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"), "blob")
    both = given.select("*", _salt().alias("salt"), F.lit(None).cast("binary").alias("blob")).unionByName(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            shard, salt = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            part = shard * SALTS + salt
            ends = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else [0]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                rows = batch.slice(a, b - a)
                if rows.column(5)[0].is_valid:
                    at, held = part[a], CuckooFilter.read(rows.column(5)[0].as_py())
                    rows = rows.slice(1)
                if at == part[a] and rows.num_rows:
                    good = held.contains(_digests(rows.column(0).to_pylist()))
                    yield rows.select([0, 1, 2]).filter(pa.array(good))

    placed = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    return placed.select("key", "id", "row", "shard", "salt", "blob").mapInArrow(run, "key binary, id long, row long")


def dropped_keys(refs: DataFrame, hot: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(id, row, keys array<binary>): what each row loses, verified against the exact counts. A hot key's
    references are met by copies of its row, one for each of SALTS parts."""
    parts = F.array(*map(F.lit, range(SALTS)))
    side = hot.select("key", "keeper", F.explode(parts).alias("salt"))
    found = passing(refs, filters, shards).withColumn("salt", _salt())
    return found.join(side, ["key", "salt"]).where("id != keeper").groupBy("id", "row").agg(F.collect_list("key").alias("keys"))


def apply_drops(docs: DataFrame, drops: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """docs by place (columns c0, c1, ...), then n_lines, n_dropped and kept."""
    need(docs, id_col, text_col)
    placed, names = by_place(docs)
    at = names.index(place_of(docs, text_col))
    kinds = [k for _, k in docs.dtypes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, names[at]):
                n_lines, n_dropped, kept = [], [], []
                for text, keys in zip(texts(part, names[at]), part.column(len(names)).to_pylist(), strict=True):
                    n = text.count("\n") + 1
                    if keys:
                        gone = set(keys)
                        lines = [x for x in text.split("\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                        n_dropped.append(n - len(lines))
                        text = "\n".join(lines)
                    else:
                        n_dropped.append(0)
                    n_lines.append(n)
                    kept.append(text)
                columns = [*part.columns[: len(names)], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped", "kept"])

    given = placed.select(id_column(place_of(docs, id_col)).alias("id"), F.xxhash64(place_of(docs, text_col)).alias("row"), *names)
    joined = given.join(drops, ["id", "row"], "left").select(*names, "keys")
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", n_lines long, n_dropped long, kept string"
    return joined.mapInArrow(run, schema)


RESULTS = ("n_lines", "n_dropped", "kept")


def _with_results(docs: DataFrame, applied: DataFrame) -> DataFrame:
    """docs' columns under their names, but for those named like a result, and the results."""
    stay = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in RESULTS]
    return applied.select(*(n for n, _ in stay), *RESULTS).toDF(*(c for _, c in stay), *RESULTS)


def _applied(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    refs = cut_local(reference_counts(docs, id_col, text_col, min_chars))
    hot = cut_local(repeated(refs, min_docs))
    shards = hot.count() // KEYS_A_SHARD + 1
    filters = cut_local(changed_filters(_inserted(hot), _no_filters(docs.sparkSession), shards))
    return apply_drops(docs, dropped_keys(refs, hot, filters, shards), id_col, text_col, min_chars)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with, beside its columns, n_lines, n_dropped and kept (the text that stays)."""
    return _with_results(docs, _applied(docs, id_col, text_col, min_chars, min_docs))


def with_kept_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, its columns and no others, each text being what stays of it; length_col, if there is one of that
    name, is its length in characters."""
    applied = _applied(docs, id_col, text_col, min_chars, min_docs)
    new = {text_col.lower(): F.col("kept"), (length_col or "").lower(): F.length("kept")}
    columns = [new.get(c.lower(), F.col(f"c{i}")).cast(k).alias(f"c{i}") for i, (c, k) in enumerate(docs.dtypes)]
    return applied.select(*columns).toDF(*docs.columns)


class LineIndex:
    """The reference table and its filters in a shared folder, over batches of inserts and deletions.

    A batch is a version. path/refs/<batch>: the changes of counts, negative for deletions; path/whole/<batch>: every
    BATCHES versions, all counts; path/filters/<batch>: the filters after it. Batches have names of their own, and
    one counts once path/versions/<version> names it, a file that is written last and never over another. So a batch
    that failed can be given again, an index can be opened again by any session, and of two sessions that add to one
    version the later one raises. Shards are as many as hold KEYS_A_SHARD keys each when the filters are built anew."""

    KEPT = ("version", "batch", "whole", "shards", "min_chars", "min_docs")

    def __init__(self, spark: SparkSession, path: str, shards: int = 16, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = {"version": 0, "batch": "", "whole": 0, "shards": shards, "min_chars": min_chars, "min_docs": min_docs}
        found = self._versions()
        at = found[-1] if found else self._new
        if (at["min_chars"], at["min_docs"]) != (min_chars, min_docs):
            raise ValueError(f"the index was made with min_chars={at['min_chars']} and min_docs={at['min_docs']}")
        self._log, self.min_chars, self.min_docs = found, min_chars, min_docs

    @property
    def version(self) -> int:
        return self._log[-1]["version"] if self._log else 0

    @property
    def shards(self) -> int:
        return (self._log[-1] if self._log else self._new)["shards"]

    def _file(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _versions(self) -> list[dict]:
        fs, where = self._file(f"{self.path}/versions")
        if not fs.exists(where):
            return []
        rows = self.spark.read.schema(", ".join(f"{n} {'string' if n == 'batch' else 'int'}" for n in self.KEPT)).json(f"{self.path}/versions")
        return sorted((r.asDict() for r in rows.where("version is not null").collect()), key=lambda r: r["version"])

    def _commit(self, entry: dict) -> None:
        fs, where = self._file(f"{self.path}/versions/{entry['version']}.json")
        out = fs.create(where, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        self._log.append(entry)

    def _changes(self, version: int) -> DataFrame:
        """(key, id, row, lines) after a version, before they are summed."""
        if not version:
            return self.spark.createDataFrame([], "key binary, id long, row long, lines long")
        whole = self._log[version - 1]["whole"]
        files = [f"{self.path}/whole/{self._log[whole - 1]['batch']}"] if whole else []
        return self.spark.read.parquet(*files, *(f"{self.path}/refs/{e['batch']}" for e in self._log[whole:version]))

    def refs(self, version: int | None = None) -> DataFrame:
        """(key, id, row, lines) after a version, lines over 0."""
        return self._summed(self._changes(self.version if version is None else version)).where("lines > 0")

    @staticmethod
    def _summed(changes: DataFrame) -> DataFrame:
        return changes.groupBy("key", "id", "row").agg(F.sum("lines").alias("lines"))

    def filters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/filters/{self._log[-1]['batch']}") if self._log else _no_filters(self.spark)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._batch(reference_counts(docs, id_col, text_col, self.min_chars))

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """docs as they were inserted; raises, changing nothing, if one isn't there (any more)."""
        self._batch(reference_counts(docs, id_col, text_col, self.min_chars).withColumn("lines", -F.col("lines")))

    def _batch(self, delta: DataFrame) -> None:
        v, batch = self.version + 1, uuid.uuid4().hex
        delta.write.parquet(f"{self.path}/refs/{batch}")
        delta = self.spark.read.parquet(f"{self.path}/refs/{batch}")
        touched = delta.select("key").distinct()
        before = self._changes(v - 1).join(touched, "key", "left_semi")
        after = cut(self._summed(before.unionByName(delta)))
        if not after.where("lines < 0").isEmpty():
            raise ValueError("a document to delete isn't in the index as it is given")
        was = repeated(self._summed(before).where("lines > 0"), self.min_docs).select("key", F.lit(-1).alias("change"))
        now = _inserted(repeated(after.where("lines > 0"), self.min_docs))
        changes = was.union(now).groupBy("key").agg(F.sum("change").alias("change")).where("change != 0")
        out = f"{self.path}/filters/{batch}"
        entry = {**self._new, "version": v, "batch": batch, "whole": self._log[-1]["whole"] if self._log else 0, "shards": self.shards}
        changed_filters(changes, self.filters(), self.shards, 4).write.parquet(out)
        if not self.spark.read.parquet(out).where("octet_length(blob) = 0").isEmpty():  # one is full: all are built anew, from the exact table
            hot = cut(repeated(self._summed(self._changes(v - 1).unionByName(delta)).where("lines > 0"), self.min_docs))
            entry["shards"] = max(self.shards, hot.count() // KEYS_A_SHARD + 1)
            changed_filters(_inserted(hot), _no_filters(self.spark), entry["shards"], 4).write.mode("overwrite").parquet(out)
        if v - entry["whole"] >= BATCHES:
            self._summed(self._changes(v - 1).unionByName(delta)).where("lines > 0").write.parquet(f"{self.path}/whole/{batch}")
            entry["whole"] = v
        self._commit(entry)

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Inserted documents with n_lines, n_dropped and kept, as the index stands."""
        refs = self.refs()
        drops = dropped_keys(refs, repeated(refs, self.min_docs), self.filters(), self.shards)
        return _with_results(docs, apply_drops(docs, drops, id_col, text_col, self.min_chars))
