"""Conversation repair against all edits of short conversations, against SQL on odd rows, and in small chunks."""

import itertools
import random

import pytest

from bytemill.llm import conversations as c
from bytemill.llm.oracles import ORACLE_SQL
from bytemill.llm.queries import op12_conversation_repair

NAME = "op12_conversation_repair"
PATTERN = {"", *("ua" * k for k in range(1, 6)), *("s" + "ua" * k for k in range(1, 6))}


def cheapest(symbols):
    """The least (cost, audit) over all edits with two inserted rows at most in a place."""
    best = (10**9, "")
    for extra in itertools.product(("", "I", "II"), repeat=len(symbols) + 1):
        for letters in itertools.product("DKR", repeat=len(symbols)):
            if any(x != "D" and s == c.MUST_GO for x, s in zip(letters, symbols, strict=True)):
                continue
            audit = "".join(a + b for a, b in zip(extra, (*letters, ""), strict=True))
            cost = sum({"I": 5, "D": 2, "R": 1, "K": 0}[x] for x in audit) + sum(5 for x, s in zip(letters, symbols, strict=True) if x != "D" and s & 1)
            if (cost, audit) >= best:
                continue
            kept, roles = iter(zip(letters, symbols, strict=True)), []
            for x in audit:
                _, s = next(kept) if x != "I" else ("", 0)
                if x != "D":
                    roles.append("?" if x in "IR" else ("s", "u", "a", "x")[s >> 1])
            if any(len(p) == len(roles) and all(r == q or (r == "?" and q != "s") for r, q in zip(roles, p, strict=True)) for p in PATTERN):
                best = (cost, audit)
    return best


def test_automaton_against_all_edits():
    draw, repairs = random.Random(1), c.Repairs()
    for _ in range(60):
        symbols = draw.choices(range(9), k=draw.randint(0, 4))
        arcs, state, total = repairs.scan(symbols, repairs.end)
        assert (total + repairs.vectors[state][0], c.trace(arcs, 0, True)[0]) == cheapest(symbols)
    for _ in range(300):
        repairs.scan(draw.choices(range(9), k=50), repairs.end)
    assert len(repairs.vectors) < 100, "few states, whatever is read"


def odd_rows():
    draw = random.Random(7)
    texts = ["Fine.", "cut", "", " \n", None, "Why?", "Fine. ", "é漢!", "x" * 3000, "so"]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [(draw.choice([*range(30), None]), draw.choice([*range(12), 40, None]), draw.choice(roles[:3] * 3 + roles), draw.choice(texts)) for _ in range(700)]
    return rows + [(77, t, r, f"Turn {t}.") for t in range(300) for r in ("user", "assistant")] + [(78, 1, "user", "Same.")] * 200 + [(79, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{at}/conversations.parquet")
    return at


def test_odd_rows(odd, same_as_sql):
    same_as_sql(op12_conversation_repair, ORACLE_SQL[NAME], odd)


@pytest.mark.parametrize("partitions", [1, 16])
def test_small_chunks(spark, odd, same_as_sql, partitions):
    """Conversations over many chunks and tasks: the same rows."""

    def query(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("turn ", c.F.lit(1))
        return c.digest(c.repair(c.damage(rows), chunk=5))

    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        same_as_sql(query, ORACLE_SQL[NAME], odd)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_hold_the_rows(spark, odd):
    rows = spark.createDataFrame([(1, 0, "user", "Hello there."), (1, 1, "user", "And more."), (1, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    pieces = c.repair(rows.withColumn("dropped", c.F.lit(False)))
    assert [r.audit for r in pieces.collect()] == ["DKK"]
    assert [(r.role, r.text) for r in c.turns(pieces).orderBy("part", "seq", "place").collect()] == [("user", "And more."), ("assistant", "Yes.")]
    assert c.digest(c.repair(c.damage(rows.limit(0)))).count() == 0
