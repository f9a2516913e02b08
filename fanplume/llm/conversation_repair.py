"""Repair of conversations by the cheapest edits that make their roles take turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf, isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fanplume.llm.common import SPACES, sliced, stored

#: What may be said next: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or re-roled turn leads, and its role; where a kept one leads by its initial (None: not allowed).
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "": (None,) * 4}
CLASSES = ("s", "u", "a", "")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Costs once all rows are done, with inserts: a conversation may end before any turn or after an assistant turn.
END = [0, 2 * INSERT, INSERT, 0]
#: Rows and characters that a piece of a conversation has at most; a longer text is a piece of its own.
PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000

_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


#: What is known of a piece before its edits, and with them.
_KNOWN = [*_long("piece"), T.StructField("whole", T.BooleanType()), *_long("first_turn", "last_turn", *_COUNTS), T.StructField("first_role", T.StringType()), T.StructField("last_role", T.StringType())]
_EDITS = [*_long("cost"), T.StructField("audit", T.StringType()), T.StructField("repaired", _TURNS)]
_OPEN = [T.StructField("codes", T.BinaryType()), T.StructField("said", _TURNS), T.StructField("through", T.ArrayType(T.DoubleType()))]


def code_of(initial: str, doomed: bool, truncated: bool) -> int:
    """All that the edits of a row depend on: the class of its role, whether it must go, whether it is truncated."""
    return (CLASSES.index(initial) if initial in CLASSES else 3) + 4 * doomed + 8 * truncated


def before(costs: list[float], code: int) -> list[float]:
    """The costs from each state before a row of this code on, from those behind it."""
    doomed, late = code & 4, TRUNCATED if code & 8 else 0
    out = []
    for state, kept in enumerate(KEEP[CLASSES[code & 3]]):
        best = DELETE + costs[state]
        if not doomed:
            best = min(best, REROLE + late + costs[NEXT[state]])
            if kept is not None:
                best = min(best, late + costs[kept])
        out.append(best)
    user, assistant = out[USER], out[ASSISTANT]
    out[USER] = user = min(user, INSERT + assistant)
    return [min(out[START], INSERT + user), min(out[SYSTEM], INSERT + user), user, min(assistant, INSERT + user)]


def checkpoints(codes: bytes, end: list[float]) -> tuple[int, list[list[float]]]:
    """The distance of the checkpoints, about the square root of the rows, and the costs at each of them and at the end."""
    step = isqrt(max(len(codes) - 1, 0)) + 1
    kept, costs = [end], end
    for i in range(len(codes) - 1, -1, -1):
        costs = before(costs, codes[i])
        if i % step == 0:
            kept.append(costs)
    return step, kept[::-1]


def edits(codes: bytes, end: list[float], state: int = START, last: bool = True) -> tuple[str, int]:
    """The edits of a stretch of rows from a state on, ASCII-least among the cheapest, and the state they lead to.

    `end` are the costs of what comes behind; only the `last` stretch inserts behind its rows. Costs are stored at
    checkpoints alone; walking forward, those of one block after the other are computed again, and of all edits that
    lose nothing against them, which have the same cost in the end, the one with the least letter is taken.
    """
    step, at = checkpoints(codes, end)
    out = []
    for block, start in enumerate(range(0, len(codes), step)):
        stop = min(start + step, len(codes))
        costs = [at[block + 1]]
        for i in range(stop - 1, start - 1, -1):
            costs.append(before(costs[-1], codes[i]))
        for i in range(start, stop):
            behind, here = costs[stop - i - 1], costs[stop - i]
            code, row_done = codes[i], False
            doomed, late = code & 4, TRUNCATED if code & 8 else 0
            while not row_done:
                kept = None if doomed else KEEP[CLASSES[code & 3]][state]
                if DELETE + behind[state] == here[state]:
                    edit, row_done = "D", True
                elif INSERT + here[NEXT[state]] == here[state]:
                    edit, state = "I", NEXT[state]
                elif kept is not None and late + behind[kept] == here[state]:
                    edit, state, row_done = "K", kept, True
                else:
                    edit, state, row_done = "R", NEXT[state], True
                out.append(edit)
    while last and state not in (START, ASSISTANT):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def applied(audit: str, said: list[tuple[str, str]], state: int = START) -> list[dict[str, str]]:
    """The turns that edits make of the turns `said`."""
    rows, out = iter(said), []
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit != "D":
            role = role if edit == "K" else ROLE[state]
            out.append({"role": role, "text": text})
            state = KEEP[role[:1]][state]
    return out


def _cost(audit: str, codes: bytes) -> int:
    rows, cost = iter(codes), 0
    for edit in audit:
        code = 0 if edit == "I" else next(rows)
        cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + (TRUNCATED if code & 8 and edit in "KR" else 0)
    return cost


def _through(codes: bytes) -> list[float]:
    """The cheapest way through a stretch from each state before it to each behind it, row by row of the former."""
    columns = []
    for to in range(4):
        costs: list[float] = [inf] * 4
        costs[to] = 0
        for code in reversed(codes):
            costs = before(costs, code)
        columns.append(costs)
    return [columns[b][a] for a in range(4) for b in range(4)]


class _Piece:
    """Rows of one conversation that come one after the other."""

    def __init__(self, conv, number: int) -> None:
        self.conv, self.number = conv, number
        self.chars, self.turns, self.said, self.codes = 0, [], [], bytearray()
        self.count = dict.fromkeys(_COUNTS, 0)

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.said and self.said[-1][0][:1] + initial not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        if turn is not None:
            self.count["n_turns"] += not self.turns or self.turns[-1] != turn
            self.turns = [*self.turns[:1], turn]
        if fault:
            self.count[fault] += 1
        self.count["n_rows"] += 1
        self.chars += len(text)
        self.said.append((role, text))
        self.codes.append(code_of(initial, fault in ("blank", "duplicate"), fault == "truncated"))

    def row(self, whole: bool) -> dict:
        out = {"conv_id": self.conv, "piece": self.number, "whole": whole, "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None}
        out |= self.count | {"first_role": self.said[0][0][:1] if self.said else None, "last_role": self.said[-1][0][:1] if self.said else None}
        codes = bytes(self.codes)
        if whole:
            audit, _ = edits(codes, END)
            return out | {"cost": _cost(audit, codes), "audit": audit, "repaired": applied(audit, self.said)}
        return out | {"codes": codes, "said": [{"role": r, "text": t} for r, t in self.said], "through": _through(codes)}


def _rows_as(schema: T.StructType, rows: Iterator[dict], most: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of `most` rows, or of about 16 million characters."""
    arrow, held, chars = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x["text"]) for n in ("said", "repaired") for x in row.get(n) or ())
        if len(held) >= most or chars > 16_000_000:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in sliced(batches):
        yield from batch.to_pylist()


def _streamed(df: DataFrame, order: list[Column], made: list[T.StructField], rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """What `rows` makes of the pieces of each conversation, which pass one task in this order without being gathered."""
    schema = T.StructType([df.schema["conv_id"], *made])
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(lambda batches: _rows_as(schema, rows(_each(batches))), schema)


def repair_conversations(turns: DataFrame, present: Column | None = None, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The cheapest edits that make a conversation an optional system turn and then user and assistant turns by turns.

    Of each row (conv_id, turn, role, text; null role or text: one space) the first fault counts: blank (white space
    only), duplicate (role and text were there before), truncated (the last character but white space is none of .!?).
    Blank and duplicate rows are deleted (cost 3); others are kept, deleted, or get the role user or assistant (2),
    and cost 1 more if truncated and not deleted; an empty user or assistant turn may be inserted anywhere (2).
    Among the cheapest edits, those whose letters D, I, K, R come first in ASCII are taken.

    Rows are ordered by turn (nulls first), role and text. Rows that aren't `present` only say that their
    conversation is there. All rows are sorted by range, so a conversation of any number of rows is spread over
    tasks; each task cuts its rows into pieces. A conversation that one piece holds is done there. For a longer one
    its pieces' boundaries are the outer checkpoints: the costs at each are put together backwards from what it costs
    to get through each piece, then states forwards, and each piece is walked on its own.

    Returns rows by piece: conv_id, piece (a number in order within a conversation), whole (all of it), first_turn and last_turn (not
    null), n_rows, n_turns (changes of the turn, plus one), blank, duplicate, truncated, illegal (neighbours within
    the piece), first_role and last_role (initials), cost, audit, repaired (role and text). `digests` puts them
    together. A null conv_id is one conversation; repeated rows are duplicates; other columns don't matter; an empty
    table gives none. Roles other than those beginning with s, u, a are never kept.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    text = lambda name: F.when(F.col("present"), F.coalesce(F.col(name), F.lit(" ")))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"), there.alias("present"))
    rows = rows.withColumns({"turn": F.when(F.col("present"), F.col("turn")), "role": text("role"), "text": text("text")})
    bare = F.rtrim("text", F.lit(SPACES))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    rows = rows.withColumn("again", again).withColumn("bare", bare)
    fault = F.when(F.col("bare") == "", "blank").when(F.col("again"), "duplicate").when(~F.substring("bare", -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "present", "again", F.when(F.col("present"), fault).alias("fault"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text", "again")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 40
        piece, edge = None, True  # edge: what came before may go on in this piece
        for r in _each(batches):
            other = piece is not None and piece.conv != r["conv_id"]
            if piece is None or other or piece.said and (len(piece.said) >= piece_rows or piece.chars + len(r["text"] or "") > piece_chars):
                if piece is not None:
                    yield piece.row(whole=other and not edge)
                    edge = not other
                number += 1
                piece = _Piece(r["conv_id"], number)
            if r["present"]:
                piece.add(r["turn"], r["role"], r["text"], r["fault"])
        if piece is not None:
            yield piece.row(whole=False)

    schema = T.StructType([turns.schema["conv_id"], *_KNOWN, *_EDITS, *_OPEN])
    pieces = stored(ranged.mapInArrow(lambda batches: _rows_as(schema, cut(batches)), schema))
    names = ["conv_id", *(f.name for f in [*_KNOWN, *_EDITS])]
    parts = pieces.filter("NOT whole")

    def costs_behind(rows: Iterator[dict]) -> Iterator[dict]:
        conv, costs = None, None
        for r in rows:
            last = costs is None or r["conv_id"] != conv
            if last:
                conv, costs = r["conv_id"], list(map(float, END))
            yield {"conv_id": conv, "piece": r["piece"], "behind": costs, "last": last}
            costs = [min(x + c for x, c in zip(r["through"][4 * a : 4 * a + 4], costs, strict=True)) for a in range(4)]

    behind = _streamed(parts.select("conv_id", "piece", "through"), [F.desc("piece")], [*_long("piece"), T.StructField("behind", T.ArrayType(T.DoubleType())), T.StructField("last", T.BooleanType())], costs_behind)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _each(batches):
            yield {"conv_id": r["conv_id"], "piece": r["piece"], "behind": r["behind"], "last": r["last"], "to": [edits(r["codes"], r["behind"], s, r["last"])[1] for s in range(4)]}

    ways = T.StructType([turns.schema["conv_id"], *_long("piece"), *behind.schema.fields[2:], T.StructField("to", T.ArrayType(T.LongType()))])
    ahead = behind.join(parts.select("piece", "codes"), "piece").select("conv_id", "piece", "behind", "last", "codes")
    ahead = ahead.mapInArrow(lambda batches: _rows_as(ways, walked(batches)), ways)

    def states(rows: Iterator[dict]) -> Iterator[dict]:
        conv, state = None, None
        for r in rows:
            if state is None or r["conv_id"] != conv:
                conv, state = r["conv_id"], START
            yield {"conv_id": conv, "piece": r["piece"], "behind": r["behind"], "last": r["last"], "state": state}
            state = r["to"][state]

    known = _streamed(ahead, [F.asc("piece")], [*ways.fields[1:4], *_long("state")], states)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _each(batches):
            audit, _ = edits(r["codes"], r["behind"], r["state"], r["last"])
            said = [(x["role"], x["text"]) for x in r["said"]]
            yield {n: r[n] for n in names} | {"cost": _cost(audit, r["codes"]), "audit": audit, "repaired": applied(audit, said, r["state"])}

    done = T.StructType([turns.schema["conv_id"], *_KNOWN, *_EDITS])
    rest = parts.drop("through").join(known.drop("conv_id"), "piece").mapInArrow(lambda batches: _rows_as(done, finish(batches)), done)
    return pieces.filter("whole").select(*names).unionByName(rest)


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, and the digest of the
    repaired turns (role:text, joined by newlines). The pieces of a long conversation pass one task in order, which
    holds none but the current one and the audit, that is one letter an edit."""
    made = [*_long("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    alone = pieces.filter("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))

    def summed(rows: Iterator[dict]) -> Iterator[dict]:
        total = None
        for r in rows:
            if total is None or total["conv_id"] != r["conv_id"]:
                if total:
                    yield closed(total)
                total = {"conv_id": r["conv_id"], "first": None, "last": None, "role": None, "turns": 0, "audits": [], "sha": hashlib.sha256(), "said": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for n in ("blank", "duplicate", "truncated", "illegal", "cost"):
                total[n] += r[n]
            if r["n_rows"]:
                total["illegal"] += total["role"] is not None and total["role"] + r["first_role"] not in ("su", "ua", "au")
                total["role"] = r["last_role"]
            if r["n_turns"]:
                total["turns"] += r["n_turns"] - (total["last"] == r["first_turn"])
                total["first"] = r["first_turn"] if total["first"] is None else total["first"]
                total["last"] = r["last_turn"]
            total["audits"].append(r["audit"])
            for t in r["repaired"]:
                total["sha"].update((("\n" if total["said"] else "") + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                total["said"] = True
        if total:
            yield closed(total)

    def closed(t: dict) -> dict:
        return {"conv_id": t["conv_id"], "gaps": t["last"] - t["first"] + 1 - t["turns"] if t["turns"] else 0, "audit": "".join(t["audits"]), "repaired_sha256": t["sha"].hexdigest()} | {n: t[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")}

    return alone.unionByName(_streamed(pieces.filter("NOT whole"), [F.asc("piece")], made, summed))
