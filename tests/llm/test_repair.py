"""Repair of conversations: cheapest and ASCII-least edits against brute force, pieces, and defined results for odd rows."""

import heapq
import random
from hashlib import sha256

import pytest

from fanplume.llm.conversation_repair import END, applied, checkpoints, code_of, digests, edits, repair_conversations
from fanplume.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query_equals_sql(same):
    same(QUERIES["op12_conversation_repair"], ORACLE_SQL["op12_conversation_repair"])


def brute_edits(rows):
    """The cheapest edits, ASCII-least among them, by Dijkstra over (rows done, roles so far up to their last two letters)."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        if i == len(rows) and (said == "" or said[-1] == "a"):
            return cost, audit
        key = (i, said[-1:])
        if (key, audit) in seen or len(audit) > 2 * len(rows) + 4:
            continue
        seen.add((key, audit))
        to = "a" if said[-1:] == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, to))
        if i < len(rows):
            role, doomed, late = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, said))
            if not doomed:
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, to))
                if role[:1] == to or role[:1] == "s" and said == "":
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1]))
    raise AssertionError


def test_edits_equal_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        rows = [(draw.choice(["user", "assistant", "system", "tool"]), draw.random() < 0.2, draw.random() < 0.2) for _ in range(draw.randint(0, 6))]
        codes = bytes(code_of(r[:1], d, t and not d) for r, d, t in rows)
        cost, audit = brute_edits([(r, d, t and not d) for r, d, t in rows])
        assert edits(codes, END)[0] == audit
        assert checkpoints(codes, END)[1][0][0] == cost


def test_checkpoints_are_as_many_as_the_square_root():
    step, kept = checkpoints(bytes(10_000), END)
    assert step == 100 and len(kept) == 101


def table(rows):
    """All columns of the result in plain Python; rows are (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = {t for known, t, _, _ in rows if known}
    initials = [r[:1] for _, _, r, _ in rows]
    cost, audit = brute_edits([(r[2], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
    every = "\n".join(f"{t['role']}:{t['text']}" for t in applied(audit, [(r[2], r[3]) for r in rows]))
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha256(every.encode()).hexdigest())


def plain(df):
    return {r["conv_id"]: tuple(r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in digests(df).collect()}


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, 5, "user", "cut of"), (2, None, "system", "Be kind."), (2, None, "user", "Yes?"), (2, 3, None, "Who?"),
    (3, 0, "user", None), (3, 1, None, None), (4, 0, "", ""), (4, 2, "tool", "x. \n"), (5, -3, "assistant", "a."), (5, 9, "assistant", "b!"), (None, 0, "user", "null id."), (None, None, "assistant", "yes."),
    (6, 0, "user", "long. " * 300_000), (6, 1, "assistant", "ok. " + " " * 300_000), (6, 2, "user", " " * 300_000 + "x"),
]


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(8)
    rows = list(ODD)
    for conv in range(10, 40):
        for turn in range(draw.randint(1, 7)):
            rows += [(conv, turn, draw.choice(["user", "assistant", "system"]), draw.choice(["One.", "Two!", "three", " ", "Four?"]))] * draw.choice([1, 1, 1, 2])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("size", [1, 2, 3, 4096])
def test_pieces_of_any_size(talks, size):
    rows = {}
    for r in talks.collect():
        rows.setdefault(r[0], []).append(tuple(r)[1:])
    pieces = repair_conversations(talks, piece_rows=size, piece_chars=50 if size == 2 else 4_000_000).cache()
    assert plain(pieces) == {k: table(v) for k, v in rows.items()}
    assert pieces.agg(F.max("n_rows")).first()[0] <= size


def test_repaired_turns_alternate(talks):
    for r in repair_conversations(talks).filter("whole").collect():
        initials = "".join(t["role"][0] for t in r["repaired"])
        assert initials.removeprefix("s") == "ua" * (len(initials) // 2) and initials != "s"


def test_rows_that_only_say_a_conversation_is_there(spark):
    df = spark.createDataFrame([(1, 0, "user", "x."), (2, 0, "user", "y.")], SCHEMA)
    got = plain(repair_conversations(df, present=F.col("conv_id") == 2))
    assert got == {1: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest()), 2: (0, 0, 0, 0, 0, 2, "KI", sha256(b"user:x.".replace(b"x", b"y") + b"\nassistant:").hexdigest())}


def test_empty_and_clashing(spark, talks):
    assert plain(repair_conversations(talks.filter("false"))) == {}
    names = ["piece", "present", "again", "bare", "fault", "codes", "said", "state", "behind"]
    assert plain(repair_conversations(talks.select("*", *(F.lit("own").alias(n) for n in names)))) == plain(repair_conversations(talks))


def test_one_long_conversation_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id", F.lit(".")).alias("text"))
    pieces = repair_conversations(rows.repartition(8), piece_rows=1000).cache()
    assert pieces.count() >= 20 and pieces.agg(F.max("n_rows")).first()[0] <= 1000
    assert plain(pieces)[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 20_000)
