"""Conversation repair against an enumeration of all edits, in whole and in blocks, and against SQL."""

import hashlib
import random

import pytest
from material import work  # noqa: F401
from pyspark.sql import functions as F

from groundtrace.llm import conversation_repair as cr
from groundtrace.llm.queries import damaged_turns

def fits(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def may_begin(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return rest == ("ua" * len(rest))[:len(rest)]


def enumerate_edits(rows):
    """Cheapest (cost, edits, turns) over all edits with up to two inserts at a place that can still fit the pattern."""
    best = None

    def go(at, cost, edits, turns, inserts):
        nonlocal best
        if best and cost > best[0] or not may_begin("".join(r[:1] for r, _ in turns)):
            return
        if at == len(rows):
            if fits("".join(r[:1] for r, _ in turns)) and (best is None or (cost, edits) < best[:2]):
                best = (cost, edits, turns)
        if inserts < 2:
            for role in ("user", "assistant"):
                go(at, cost + 2, edits + "I", [*turns, (role, "")], inserts + 1)
        if at < len(rows):
            row = rows[at]
            go(at + 1, cost + 3, edits + "D", turns, 0)
            if not row.deleted:
                go(at + 1, cost + row.truncated, edits + "K", [*turns, (row.role or "-", row.text)], 0)
                for role in ("user", "assistant"):
                    go(at + 1, cost + 2 + row.truncated, edits + "R", [*turns, (role, row.text)], 0)

    go(0, 0, "", [], 0)
    return best


@pytest.mark.parametrize("block", [1, 2, 64])
def test_search_against_enumeration(monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block)
    rng = random.Random(block)
    for _ in range(60):
        rows = [cr.Row(rng.choice(["user", "assistant", "system", "tool", "", "ä"]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3)
                for i in range(rng.randint(0, 5))]
        conversation = cr.Conversation()
        for row in rows:
            conversation.add(row)
        cost, edits, turns = enumerate_edits(rows)
        said = "\n".join(f"{r}:{t}" for r, t in turns)
        assert conversation.finish() == (cost, edits, hashlib.sha256(said.encode()).hexdigest())


def test_blocks_agree_on_long_conversations(monkeypatch):
    rng = random.Random(9)
    rows = [cr.Row(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(400)]
    got = []
    for block in (7, 64, 1000):
        monkeypatch.setattr(cr, "BLOCK_ROWS", block)
        conversation = cr.Conversation()
        for row in rows:
            conversation.add(row)
        got.append(conversation.finish())
    assert got[0] == got[1] == got[2]


def test_suffix_bounds_never_exceed_the_cost():
    rng = random.Random(2)
    for _ in range(200):
        rows = [cr.Row(rng.choice(["user", "assistant", "system", "x"]), "t", rng.random() < 0.2, rng.random() < 0.3)
                for _ in range(rng.randint(0, 6))]
        assert cr.suffix_bounds(rows, cr.FINAL)[0][0] <= cr.search(rows, {cr.START: (0, "")}, cr.FINAL)[0]


SHAPE = "conv_id long, turn long, role string, text string, place int, edits string, seen int"


def test_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 4, "assistant", " "), (1, 2, None, None), (1, 2, "assistant", "Yes!"), (1, 2, "assistant", "Yes!"),
            (None, None, None, None), (2, 1, "system", "Be."), (3, 5, "user", "Long " * 50000 + "end."), (3, 6, "assistant", "Ok"),
            (4, 1, "user", "Gone."), (5, -3, "", "x.")]
    table = spark.createDataFrame([(*r, 1, "e", 2) for r in rows], SHAPE).withColumn("there", F.col("conv_id").isNull() | (F.col("conv_id") != 4))
    turns = table.repartition(5)
    found = cr.repair(turns, present="there")
    got = {r.conv: r for r in found.collect()}
    assert {k: r.edits for k, r in got.items()} == {1: "KDKDD", 2: "D", 3: "KK", 4: "", 5: "D", None: "D"}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost) == (1, 2, 1, 0, 4, 9)
    assert (got[3].cost, got[3].truncated, got[4].cost, got[4].gaps, got[4].digest) == (1, 1, 0, 0, hashlib.sha256(b"").hexdigest())
    texts = cr.repaired_turns(turns, found, present="there").collect()
    for conv, row in got.items():
        own = sorted((t.place, f"{t.role}:{t.text}") for t in texts if t.conv == conv)
        assert hashlib.sha256("\n".join(s for _, s in own).encode()).hexdigest() == row.digest
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
    assert cr.repair(turns.limit(0), present="there").count() == 0


def test_repaired_turns_of_the_table(spark):
    turns = damaged_turns(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    found = cr.repair(turns, present="present")
    texts = cr.repaired_turns(turns, found, present="present").groupBy("conv").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", F.concat("role", F.lit(":"), "text").alias("s")))), lambda t: t["s"]), "\n"), 256).alias("own"))
    empty = hashlib.sha256(b"").hexdigest()
    joined = found.join(texts, "conv", "left").select("digest", F.coalesce("own", F.lit(empty)).alias("own")).collect()
    assert joined and all(r.digest == r.own for r in joined)
