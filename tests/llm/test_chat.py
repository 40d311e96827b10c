import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat as c
from tracewell.llm.queries import op10_chat

ROLE = {1: "system", 2: "user", 3: "assistant"}


def legal(roles):
    r = list(roles[1:] if roles[:1] == ("system",) else roles)
    return r == ["user", "assistant"] * (len(r) // 2) and (not roles or len(r) > 0)


def cheapest(codes):
    """By trying every relabelling and merge, and the fewest insertions that make what results legal."""
    best = 1 << 30
    for to in itertools.product((1, 2, 3), repeat=len(codes)):
        base = sum(2 for a, b in zip(codes, to, strict=True) if a != b)
        same = [k for k in range(1, len(to)) if to[k] == to[k - 1]]
        for merged in itertools.chain.from_iterable(itertools.combinations(same, n) for n in range(len(same) + 1)):
            turns = [ROLE[x] for k, x in enumerate(to) if k not in merged]
            added, state = 0, ""
            for t in turns:
                if t == "system":
                    if state:
                        added = 1 << 20
                elif t == "user" and state == "user" or t == "assistant" and state in ("", "system", "assistant"):
                    added += 1
                state = t
            added += {"": 0, "system": 2, "user": 1, "assistant": 0}[state]
            best = min(best, base + len(merged) + 3 * added)
    return best


def spoken(rows):
    out = []
    for role, action, before in rows:
        out += [ROLE[x] for x in before]
        if not action.endswith("merge"):
            out.append(ROLE[role])
    return out


def test_repair_is_legal_and_cheapest():
    for n in range(5):
        for codes in itertools.product(range(4), repeat=n):
            cost, rows, ending = c.repair(list(codes))
            assert legal(tuple(spoken(rows) + [ROLE[x] for x in ending]))
            assert cost == cheapest(codes)


def text_of(rows):
    return "".join(r["rendered"] for r in sorted(rows, key=lambda r: (r["chunk"], r["seq"])))


@pytest.mark.parametrize("chunk", [3, 256])
def test_chunks_give_the_cost_of_the_whole(spark, monkeypatch, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    rng = random.Random(8)
    names = ["system", "user", "assistant", "tool"]
    turns = [(conv, k, rng.choice(names), f"t{conv}.{k}") for conv in range(25) for k in range(rng.randint(1, 30))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {}
    for r in c.render(df).collect():
        got.setdefault(r["conv_id"], []).append(r)
    code = {"system": 1, "user": 2, "assistant": 3, "tool": 0}
    for conv, rows in got.items():
        own = [t for t in turns if t[0] == conv]
        assert sum(r["cost"] for r in rows) == c.repair([code[t[2]] for t in own])[0]
        text = text_of(rows)
        assert all(t[3] in text for t in own) and text.endswith("<|end|>\n")
        roles = tuple(x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end"))
        assert legal(roles) and text.count("<|end|>") == len(roles)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, None, " User ", "x"), (2, 5, "ASSISTANT", ""), (None, 0, "assistant", "y" * 100_000), (3, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("seq", F.lit(1)).withColumn("cost", F.lit("x"))
    out = c.render(df)
    got = {}
    for r in out.collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert text_of(got[1]) == "<|user|>\na\n\na<|end|>\n<|assistant|>\n<|end|>\n"
    assert text_of(got[2]) == "<|user|>\nx<|end|>\n<|assistant|>\n<|end|>\n"
    assert [r["action"] for r in sorted(got[None], key=lambda r: r["seq"])] == ["insert", "keep"]
    assert text_of(got[3]).count("<|end|>") in (2, 3)
    assert c.render(df.limit(0)).count() == 0


def test_rows_without_turn_numbers_are_cut_by_place(spark, monkeypatch):
    """A hot conversation whose turns are all null or one number: no run of rows outgrows a part."""
    turns = [(1, None if i % 2 else 7, ("user", "assistant", "other", None)[i % 4], f"t{i % 900:03}" if i % 3 else None) for i in range(4000)]
    turns += [(2, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    parts = c._in_parts(df.selectExpr("conv_id as conv", "cast(coalesce(floor(turn / 256), -1) as long) as chunk", "turn", "1 as role", "role as role_order", "text"))
    assert parts.count() == len(turns) and parts.groupBy("conv", "chunk", "part").count().agg({"count": "max"}).first()[0] <= c.CHUNK
    out = [tuple(r) for r in c.render(df).orderBy("conv_id", "chunk", "seq").collect()]
    monkeypatch.setattr(c, "CROWDED", 1 << 40)
    whole = [tuple(r) for r in c.render(df).orderBy("conv_id", "chunk", "seq").collect()]
    for conv in (1, 2):
        a, b = ([r for r in rows if r[0] == conv] for rows in (out, whole))
        assert sum(r[6] for r in a) == sum(r[6] for r in b)
        assert len({(r[1], r[2]) for r in a}) == len(a) and sum(r[4] != "insert" for r in a) == sum(t[0] == conv for t in turns)
    key = lambda r: [(x is not None, x) for x in r[1:]]
    read = [(r[3], re.sub(r"^(<\|end\|>\n)?(<\|\w+\|>\n|\n\n)|<\|end\|>\n$", "", r[7])) for r in out if r[0] == 1 and r[4] != "insert"]
    assert read == [(t[1], t[3] or "") for t in sorted((t for t in turns if t[0] == 1), key=key)]


def test_the_query_on_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    got = {}
    for r in op10_chat(spark, d).collect():
        got.setdefault(r["conv_id"], []).append(r)
    own = {}
    for t in sorted(turns, key=lambda t: [(x is not None, x) for x in t[:3]]):
        own.setdefault(t[0], []).append(t)
    assert got.keys() == own.keys()
    code = {"system": 1, "user": 2, "assistant": 3}
    for conv, rows in got.items():
        text = text_of(rows)
        roles = tuple(x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end"))
        assert legal(roles) and all((t[3] or "") in text for t in own[conv])
        assert sum(r["cost"] for r in rows) == c.repair([code.get((t[2] or "").strip().lower(), 0) for t in own[conv]])[0]
