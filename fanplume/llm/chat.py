"""Chat formatting with loss masks that are found from the rendered text alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turn = tuple[str, str]
Renderer = Callable[[list[Turn]], str]


def probe_for(turns: list[Turn], out: str) -> str:
    """A private-use character that neither the turns nor their rendering hold."""
    held = set(out).union(*(r + t for r, t in turns))
    return next(chr(c) for c in chain(range(0xE000, 0xF900), range(0xF0000, 0x10FFFE)) if chr(c) not in held)


class TurnTemplate:
    """`### role: text </turn>` a turn. Backslash, `#` and `<` inside texts are escaped, so no text can hold a mark."""

    _OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l", "\n": "\\n", ":": "\\c"}
    _IN = {v[1]: k for k, v in _OUT.items()}
    _TURN = re.compile(r"### ([^:#<]*): ([^#<]*) </turn>\n")

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: self._IN[m[1]], text)

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"### {self.escape(r).replace(':', '\\c').replace('\n', '\\n')}: {self.escape(t)} </turn>\n" for r, t in turns)

    def parse(self, text: str) -> list[Turn]:
        """The turns of a rendered conversation."""
        found, at = [], 0
        while at < len(text):
            m = self._TURN.match(text, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            found.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        return found


Span = tuple[int | None, int | None, int, int]


def locate(render: Renderer, turns: list[Turn]) -> tuple[str, list[Span | None], int | None]:
    """The rendered conversation, (start, end, text start, text end) of each turn in it, and the first turn whose
    addition rewrites what was rendered before it (None if none does).

    `render` is a black box: successive prefixes of the conversation are rendered and compared. A constant ending
    (of the conversation, not of a turn) may follow every output. A turn's text is where a probe in its place shows.
    Where history is rewritten, prefixes tell nothing about the final rendering, so each turn is probed in the whole
    conversation: start and end are None then, and a turn whose text isn't shown, or not once, has no span.
    """
    whole = render(turns)
    probe = probe_for(turns, whole)
    empty = render([])
    spans: list[Span | None] = []
    ending = empty
    if turns:
        first = render(turns[:1])
        # What an empty conversation shows is a beginning, an ending or both.
        ending = empty[len(commonprefix([empty, first])) :]
        if not first.endswith(ending):
            return whole, _probed(render, turns, whole, probe), 0
    body = empty[: len(empty) - len(ending)]
    for k, (role, _) in enumerate(turns):
        out = render(turns[: k + 1])
        probed = render([*turns[:k], (role, probe)])
        before = probed.find(probe, len(body))
        after = len(probed) - len(ending) - before - 1
        new = out[: len(out) - len(ending)]
        known = out.startswith(body) and out.endswith(ending) and probed.startswith(body) and before >= 0 and len(new) - after >= before and out[:before] == probed[:before]
        if not known:
            return whole, _probed(render, turns, whole, probe), k
        spans.append((len(body), len(new), before, len(new) - after))
        body = new
    return whole, spans, None


def _probed(render: Renderer, turns: list[Turn], whole: str, probe: str) -> list[Span | None]:
    """Where each turn's text shows in `whole`, from renderings of all turns with a probe in its place."""
    spans: list[Span | None] = []
    for k, (role, _) in enumerate(turns):
        out = render([*turns[:k], (role, probe), *turns[k + 1 :]])
        before = out.find(probe)
        end = len(whole) - (len(out) - before - 1)
        shown = before >= 0 and out.count(probe) == 1 and before <= end and whole[:before] == out[:before] and whole[end:] == out[before + 1 :]
        spans.append((None, None, before, end) if shown else None)
    return spans


FORMATTED = T.StructType(
    [
        T.StructField("n_turns", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("start", "end", "text_start", "text_end"))]))),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("rewritten_at", T.LongType()),
    ]
)


def format_conversations(
    turns: DataFrame, render: Renderer | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: its id, n_turns, formatted text, the span of each turn, the loss mask as spans of the
    texts of `loss_roles`, and rewritten_at: the first turn that rewrites history (null if none does; see `locate`).

    A conversation is one value in the end, so its rows meet in one group; prefixes cost the square of its number of
    turns. Turns with the same number come by role, then text; null roles and texts are empty; a null turn number
    comes first; rows with a null id are one conversation. Other columns are not returned.
    """
    render = render or TurnTemplate()
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("row")
    )
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(F.col("conv"), F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), *FORMATTED.fields])
    arrow = to_arrow_schema(FORMATTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out, spans, rewritten = locate(render, list(zip(roles, texts, strict=True)))
                made.append(
                    {
                        "n_turns": len(roles),
                        "formatted": out,
                        "turns": [dict(zip(("role", "start", "end", "text_start", "text_end"), (r, *(s or (None,) * 4)), strict=True)) for r, s in zip(roles, spans, strict=True)],
                        "loss": [{"start": s[2], "end": s[3]} for r, s in zip(roles, spans, strict=True) if s and r in loss_roles],
                        "rewritten_at": rewritten,
                    }
                )
            new = pa.RecordBatch.from_pylist(made, arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *new.columns], schema.names)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame, template: TurnTemplate | None = None, conv_col: str = "conv_id") -> DataFrame:
    """What `formatted` (of `format_conversations` with this template) says when it is read back: n_turns and
    turns_sha256 of the turns parsed from the text, loss_chars and loss_sha256 of the text under the loss mask,
    formatted_chars. One row per row of `formatted`, null ids and repeated ones included; a text of no turns gives 0
    and the digest of the empty text; other columns are not returned; a text that is no rendering is an error."""
    import hashlib

    template = template or TurnTemplate()
    made = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField(conv_col, formatted.schema[conv_col].dataType), *made])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = template.parse(text)
                learned = "".join(template.unescape(text[x["start"] : x["end"]]) for x in loss)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], schema.names)

    return formatted.select(conv_col, "formatted", "loss").mapInArrow(run, schema)
