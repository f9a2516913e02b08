"""Quality filtering with a learned decision list over document statistics."""

from __future__ import annotations

import functools
import operator
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.llm.common import SPACES, map_columns, words_of

SYMBOLS = "#*$%&|<>"
_UPPER = string.ascii_uppercase.encode()
_LOWER = string.ascii_lowercase.encode()
_DIGITS = string.digits.encode()

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_lower", "n_digits", "n_ends", "n_distinct_words"]
MADE = [T.StructField(n, T.LongType()) for n in BASE + EXTRA]


def repeat_words(words: list[bytes], n: int = 8) -> int:
    """How many words lie in runs of `n` words that the text holds twice or more, first ones included.

    Runs are compared exactly: ranks of runs of 1, 2, 4, ... words are doubled, which needs `n` to be a power of two.
    """
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    step = 1
    while step < n:
        _, rank = np.unique(rank[:-step] * len(words) + rank[step:], return_inverse=True)
        step *= 2
    again = np.bincount(rank)[rank] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(again)] += again
    edge[n : n + len(again)] -= again
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """BASE and EXTRA of one whole text; all 0 for a null or empty one."""
    words = words_of(text)
    if not words:
        return (0,) * 2 + (sum(map((text or "").count, SYMBOLS)),) + (0,) * 7
    raw = text.encode("utf-8", "surrogatepass")
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        less(_UPPER), less(_LOWER), less(_DIGITS), less(b".!?"), len(set(words)),
    )


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the columns BASE and EXTRA to `docs`; columns of those names are replaced."""

    def fn(texts: list) -> list:
        return [list(x) for x in zip(*map(statistics, texts), strict=True)] if texts else [[] for _ in MADE]

    return map_columns(docs, [text_col], MADE, fn)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """What conditions are about."""
    return {
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "digit_share": _share("n_digits", "word_chars"),
        "ends_per_word": _share("n_ends", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        f = features()[self.feature]
        return f > F.lit(self.threshold) if self.above else f <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, in the order they are asked; a document that none holds for is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        """The list as one conditional expression over the columns of `with_statistics`."""
        verdict = None
        for rule in self.rules:
            test = functools.reduce(operator.and_, (c.column() for c in rule))
            verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "else keep"])


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """FOIL's information gain of narrowing (p0, n0) to (p, n)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (~bad[inside]).any():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, values in x.items():
            own, own_bad = values[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            v, b = own[order], np.cumsum(own_bad[order])
            ends = np.flatnonzero(v[:-1] < v[1:])
            if not len(ends):
                continue
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            p, n = b[ends], ends + 1 - b[ends]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(pp, nn, p0, n0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x[best[1].feature])
    return rule


def _covered(rule: list[Condition], x: dict[str, np.ndarray], size: int) -> np.ndarray:
    return functools.reduce(operator.and_, (c.holds(x[c.feature]) for c in rule), np.ones(size, bool))


def cover(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_covered: int = 3, max_conditions: int = 4, max_rules: int = 24, cuts: int = 256) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of the rows left, prune its last conditions on the other third,
    keep it if it is precise on the latter, drop the rows it covers, and go on."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules:
        g, t = left & ~third, left & third
        if not bad[g].any():
            break
        rule = _grow({k: v[g] for k, v in x.items()}, bad[g], max_conditions, cuts)
        if not rule:
            break
        xt = {k: v[t] for k, v in x.items()}

        def worth(own: list[Condition]) -> float:
            c = _covered(own, xt, int(t.sum()))  # noqa: B023
            p, n = int((bad[t] & c).sum()), int((~bad[t] & c).sum())  # noqa: B023
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c = _covered(rule, x, len(bad)) & left
        p, n = int((bad & c).sum()), int((~bad & c).sum())
        if worth(rule) < 2 * min_precision - 1 or p < min_covered or p < min_precision * (p + n):
            break
        rules.append(tuple(rule))
        left &= ~c
    return DecisionList(tuple(rules))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 16_000, **options) -> DecisionList:
    """Learn the list on a bounded sample of labelled documents: the `max_rows` labels with the smallest hashes of ids.

    Documents that fail the base rules teach nothing. Null labels, and labels of documents that aren't there, are
    left out; without any, the list is empty and keeps all. A document with several labels counts with the lowest,
    and of rows that repeat an id the least text counts, so the sample is bounded whatever repeats.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(marked), "id")
    rows = with_statistics(rows.groupBy("id", "label").agg(F.min("text").alias("text"))).filter(~base_failed()).select("id", "label", *(c.alias(n) for n, c in features().items())).toPandas()
    rows = rows.sort_values(["id", *features()], kind="stable")
    return cover({n: rows[n].to_numpy(float) for n in features()}, rows["label"].to_numpy() == 0, **options)


def apply_quality(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """Add the statistics, base_failed and kept to `docs`; columns of those names are replaced.

    Null and empty texts have no words and fail the base rules.
    """
    return with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())
