"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): every pair of
features interacts through vectors of low rank, in time linear in a text's features by the
sum-of-squares identity. Features are the words of the whole text, lower-cased and hashed into BUCKETS
(weight 1 + log of their count, of length one over a text), statistics of its characters, words and
lines, each cut into levels, and as metadata its length in characters, words and lines. Label, language,
source and id are no features.

The machine is fitted in one task, on at most max_train labelled rows (a documented bound: those that
come first by a hash of the id; their features, not their texts, reach that task); what the driver gets and
broadcasts is a fixed (BUCKETS + levels) x (rank + 1) floats. Scoring needs no shuffle.

Defined results: a null text is an empty one and gets a score like any other; a null id is held out and
never learned from; labels other than 0 and 1 are left out; repeated rows get a row each, a repeated label
counts once; without labels of both kinds every score is the share of ones (0.5 without any); an empty
table gives an empty table. Other columns of the input are not carried along.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm._common import need, pieces_of, texts

BUCKETS = 1 << 14
LEVELS = 12
THRESHOLD = 0.3
FOLDS = 5
MAX_TRAIN = 6_000

STATS = 17
SIZE = BUCKETS + STATS * LEVELS
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Last bytes of words: those that end a phrase, and those that rarely stand there.
_END = np.zeros(256, bool)
_END[[*b".,;:"]] = True
_ODD = np.array([c < 128 and not chr(c).isalnum() and chr(c) not in ".,;:?!" for c in range(256)])


def _share_level(x: float) -> int:
    """A level for a share from 0 to 1, finer near 0."""
    return min(LEVELS - 1, int(LEVELS * math.sqrt(x)))


def _log_level(n: float) -> int:
    return min(LEVELS - 1, int(math.log2(n + 1)))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices below SIZE, each once, and values."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(raw.lower().split())
    at, place = np.unique(np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % BUCKETS, return_inverse=True)
    weight = np.bincount(place, 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts))))
    norm = math.sqrt(weight @ weight) or 1.0
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, n_words, lines = max(1, len(raw)), max(1, len(words)), text.split("\n")
    line_counts = Counter(lines)
    full = sum(map(len, lines)) or 1
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    last = np.bincount(np.frombuffer(bytes([w[-1] for w in words]), np.uint8), minlength=256)
    ends, odd = last[_END].sum(), last[_ODD].sum()
    marks = h[_MARK]
    stats = (
        _log_level(len(text)), _log_level(len(words)), _log_level(len(lines)),
        _share_level(h[_UPPER].sum() / n), _share_level(h[_LOWER].sum() / n), _share_level(h[_DIGIT].sum() / n), _share_level(marks.sum() / n),
        _share_level(h[33] / n), _share_level((marks.max() if raw else 0) / n), _share_level(ends / n_words), _share_level(odd / n_words),
        min(LEVELS - 1, int(sizes.sum() / n_words)), _share_level(len(counts) / n_words), _share_level(max(counts.values(), default=0) / n_words),
        _share_level(sum(len(x) * (c - 1) for x, c in line_counts.items()) / full), _log_level(full / len(lines)), _share_level((sizes == 1).sum() / n_words),
    )
    more = BUCKETS + np.arange(STATS, dtype=np.int32) * LEVELS + np.array(stats, np.int32)
    return np.concatenate([at.astype(np.int32), more]), np.concatenate([(weight / norm).astype(np.float32), np.full(STATS, 0.35, np.float32)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # (SIZE,)
    factors: np.ndarray  # (SIZE, rank)

    def raw(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid of rows laid end to end, and each row's sums by factor."""
        vx = self.factors[at] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[at] * value, starts) + pairs, sums

    def score(self, batch: list[str]) -> np.ndarray:
        rows = [features(t) for t in batch]
        at, value, starts = _laid(rows)
        return 1 / (1 + np.exp(-np.clip(self.raw(at, value, starts)[0].astype(np.float64), -30, 30)))


def _laid(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), starts


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.08, decay: float = 2e-4, seed: int = 11) -> Machine:
    """By AdaGrad on the logistic loss, in seeded order."""
    random = np.random.default_rng(seed)
    ones = float(labels.mean()) if len(labels) else 0.5
    machine = Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, rank), np.float32))
    if ones in (0.0, 1.0) or not len(labels):
        machine.bias = math.log(max(ones, 1e-9) / max(1 - ones, 1e-9)) if len(labels) else 0.0
        return machine
    machine.bias = math.log(ones / (1 - ones))
    machine.factors = random.normal(0, 0.02, (SIZE, rank)).astype(np.float32)
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, rank), 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for i in range(0, len(order), 128):
            part = order[i : i + 128]
            at, value, starts = _laid([rows[k] for k in part])
            raw, sums = machine.raw(at, value, starts)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]).astype(np.float32) / len(part) * 16
            lengths = np.diff([*starts, len(at)])
            own = np.repeat(error, lengths)
            touched, place = np.unique(at, return_inverse=True)
            grad_w = np.bincount(place, own * value, len(touched)).astype(np.float32) + decay * machine.weights[touched]
            each = (own * value)[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[at] * value[:, None])
            grad_v = np.stack([np.bincount(place, each[:, f], len(touched)) for f in range(rank)], axis=1).astype(np.float32) + decay * machine.factors[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            machine.weights[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            machine.factors[touched] -= rate * grad_v / np.sqrt(seen_v[touched])
            seen_b += float(error.sum()) ** 2
            machine.bias -= rate * float(error.sum()) / math.sqrt(seen_b)
    return machine


def held_out(df: DataFrame, id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 over FOLDS; a null id does."""
    return F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Machine:
    need(docs, id_col, text_col)
    need(labels, id_col, label_col)
    known = labels.where(~held_out(labels, id_col) & labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                found = [features(t) for t in texts(part)]
                at, value = ([x[k].tobytes() for x in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["id", "label", "at", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("at", "ascending")])
            found = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for a, v in zip(rows["at"], rows["value"], strict=True)]
            machine = fit(found, rows["label"].to_numpy().astype(np.float32))
            yield pa.RecordBatch.from_pydict({"bias": [machine.bias], "weights": [machine.weights.tobytes()], "factors": [machine.factors.tobytes()]})

    learned = given.mapInArrow(run, "id long, label int, at binary, value binary").repartition(1).mapInArrow(learn, "bias double, weights binary, factors binary").first()
    if learned is None:
        return fit([], np.empty(0, np.float32))
    return Machine(learned["bias"], np.frombuffer(learned["weights"], np.float32), np.frombuffer(learned["factors"], np.float32).reshape(SIZE, -1))


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out boolean, score double, predicted int) of each row."""
    need(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                score = shared.value.score(texts(part))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    given = docs.select(docs[id_col].alias("id"), held_out(docs, id_col).alias("held"), docs[text_col].alias("text"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    need(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, names[at]):
                yield part.filter(pa.array(shared.value.score(texts(part, names[at])) >= threshold))

    schema = ", ".join(f"{n} {k}" for n, (_, k) in zip(names, docs.dtypes, strict=True))
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
