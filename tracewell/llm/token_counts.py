"""Token counts of a sentencepiece model, by a two-tier lookup on the map side.

A text is cut into pre-tokens at places that no piece of the model spans: before a run of spaces that
follows something else, and before a newline. A text's count is the sum of its pre-tokens' counts.
Tier one is a broadcast table of the most frequent pre-tokens of the whole table and their counts (a
summary of bounded size from each partition, merged as a tree; no pre-token is shuffled). Tier two is a
bounded cache in each worker, filled by the library on a miss. Both tiers hold true counts, so neither
can change a result; a model for which those cuts aren't safe is given whole texts.

Defined results: a null or empty text has 0 tokens; repeated rows and ties give a row each; an empty
table gives an empty table; other columns of the input, whatever their names, are not carried along.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from tracewell.llm._common import need, pieces_of, texts

SPACE = "▁"
CACHED = 64
CACHE_ENTRIES = 400_000
WHOLE_SPLIT = 1 << 20
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def cuts_are_safe(model: sentencepiece.SentencePieceProcessor, spec: bytes) -> bool:
    """Whether no piece has a space sign after another character, or a newline, and text stays as it is."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in pieces)
    return plain and model.encode_as_pieces("a  b\n") == model.encode_as_pieces("a") + model.encode_as_pieces(" b") + model.encode_as_pieces("\n")[1:]


def _key(pre_token: str) -> str:
    """A pre-token without its space, if that is a single one before a character."""
    return pre_token[1:] if pre_token[0] == " " and pre_token[1:2] not in ("", " ") else pre_token


def split(text: str) -> Iterator[list[str]]:
    """Lists of pre-tokens. One begins with the run of spaces or the newline before it, but a single space before a
    character is left out; a lone space is one itself."""
    text = " " + text.replace(SPACE, " ")
    if len(text) <= WHOLE_SPLIT:
        if "  " in text or " \n" in text:
            yield [*map(_key, PRE_TOKEN.findall(text))]
            return
        found = text[1:].replace("\n", " \n").split(" ")  # as the pattern would, but faster
        if not found[-1]:
            found[-1] = " "
        yield found
        return
    found = (_key(m.group()) for m in PRE_TOKEN.finditer(text))
    while part := list(islice(found, 200_000)):
        yield part


class Lengths(dict):
    """Counts by pre-token: tier one, and what the library said since."""

    def __init__(self, spec: bytes, frequent: dict[str, int]):
        super().__init__(frequent)
        self.frequent = frequent
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.safe = cuts_are_safe(self.model, spec)

    def counted(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """Counts by the library. It puts a space before each text: that is the pre-token's own first
        space; before a newline it is a token of its own."""
        spaced = [p for p in pre_tokens if p[0] != "\n" and p != " "]
        broken = [p for p in pre_tokens if p[0] == "\n"]
        out = dict(zip(spaced, map(len, self.model.encode([p[p[0] == " " :] for p in spaced], num_threads=1)), strict=True)) if spaced else {}
        if broken:
            out.update((p, len(ids) - 1) for p, ids in zip(broken, self.model.encode(broken, num_threads=1), strict=True))
        if " " in pre_tokens:
            out[" "] = 1
        return out

    def learn(self, pre_tokens: Iterable[str]) -> dict[str, int]:
        """Have the library count what both tiers lack; returns the long ones, which aren't kept."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        new = self.counted({*pre_tokens}.difference(self))
        long = {p: n for p, n in new.items() if len(p) > CACHED}
        for p in long:
            del new[p]
        self.update(new)
        return long

    def _sum(self, pre_tokens: list[str], long: dict[str, int]) -> int:
        if not long:
            return sum(map(self.__getitem__, pre_tokens))
        get = self.get
        return sum([long[p] if (n := get(p)) is None else n for p in pre_tokens])

    def of(self, texts: list[str]) -> list[int]:
        """The texts' counts."""
        if not self.safe:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []
        out, unknown, get = [0] * len(texts), {}, self.get
        for i, t in enumerate(texts):
            if t and len(t) < WHOLE_SPLIT:
                found = next(split(t))
                counts = [*map(get, found)]
                if None in counts:
                    unknown[i] = [p for p, n in zip(found, counts, strict=True) if n is None]
                    counts = [n for n in counts if n]
                out[i] = sum(counts)
        long = self.learn(chain.from_iterable(unknown.values()))
        for i, found in unknown.items():
            out[i] += self._sum(found, long)
        for i, t in enumerate(texts):
            if t and len(t) >= WHOLE_SPLIT:
                out[i] = sum(self._sum(part, self.learn(part)) for part in split(t))
        return out


def _most(c: Counter, n: int) -> Counter:
    return c if len(c) <= n else Counter(dict(c.most_common(n)))


def frequent_pre_tokens(df: DataFrame, text_col: str, n: int, kept: int) -> list[str]:
    """About the n most frequent pre-tokens of at most CACHED characters. Each partition counts all of
    its own, dropping the rarest while it holds over 8 * kept, and sends kept; the driver gets n."""

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in pieces_of(batch, "text"):
                for t in texts(part):
                    for found in split(t):
                        seen.update(found)
                    if len(seen) > 8 * kept:
                        seen = _most(seen, 4 * kept)
        seen = _most(Counter({k: v for k, v in seen.items() if len(k) <= CACHED}), kept)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(dict(seen))], pa.binary())], ["summary"])

    rows = df.select(df[text_col].alias("text")).mapInArrow(summary, "summary binary")
    merged = rows.rdd.treeAggregate(Counter(), lambda c, r: _most(c + Counter(pickle.loads(bytes(r[0]))), n), lambda a, b: _most(a + b, n), depth=3)
    return [k if k[0] in " \n" else " " + k for k, _ in merged.most_common(n)]


class Packed:
    """The frequent table as it is broadcast: one string's bytes, ends and counts."""

    def __init__(self, counts: dict[str, int]):
        words = [w.encode() for w in counts]
        self.bytes, self.ends = b"".join(words), np.cumsum([len(w) for w in words], dtype=np.uint32)
        self.counts = np.array([*counts.values()], np.uint16)

    def unpacked(self) -> dict[str, int]:
        out, start = {}, 0
        for end, n in zip(self.ends.tolist(), self.counts.tolist(), strict=True):
            out[self.bytes[start:end].decode()] = n
            start = end
        return out


_lengths: dict[int, Lengths] = {}


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 16_384, kept: int = 4_096) -> DataFrame:
    """(id, n_bytes long, n_tokens long) of each row. model: a sentencepiece model file, read by the
    driver. frequent: entries of the broadcast table, of at most 4 * CACHED bytes each."""
    need(df, id_col, text_col)
    with open(model, "rb") as f:
        spec = f.read()
    own = Lengths(spec, {})
    table = Packed(own.counted({*map(_key, frequent_pre_tokens(df, text_col, frequent, kept))}) if own.safe else {})
    shared = df.sparkSession.sparkContext.broadcast((spec, table))
    kind, key = dict(df.dtypes)[id_col], shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lengths:
            _lengths.clear()
            spec, table = shared.value
            _lengths[key] = Lengths(spec, table.unpacked())
        lengths = _lengths[key]
        for batch in batches:
            for part in pieces_of(batch, "text"):
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                counts = pa.array(lengths.of(texts(part)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, counts], [id_col, "n_bytes", "n_tokens"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
