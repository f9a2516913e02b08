"""Benchmark decontamination: approximate occurrences of benchmark items in documents."""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fanplume.llm.common import SPACES, discard, sliced, stored

_BITS = 21
_GAP = "\0"


def _folded() -> np.ndarray:
    """Code points as compared: A-Z as a-z, ASCII white space as a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[ord(c) for c in SPACES]] = 32
    table[65:91] += 32
    return table


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams of a code point array; q is a power of two."""
    h, step, factor = codes.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    while step < q:
        h = h[: max(len(h) - step, 0)] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor * 0x9E3779B97F4A7C15 % 2**64 | 1
    return h


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int, begin: int | None = None, starts: tuple[int, int] | None = None) -> tuple[int, int]:
    """The least edit distance of all of `item` to a substring of `text`, and its end, within a band.

    The substring begins at `begin`, or in the range `starts`, or anywhere if neither is given. Row i of the table
    holds the substrings that end at low + i + j for j in 0 .. width - 1; ends outside the text don't count. Gives up
    early (most + 1, 0) when a whole row exceeds `most`.
    """
    steps = np.arange(width)
    padded = np.full(len(item) + width + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(low, 0), min(low + len(item) + width, len(text))
    if a < b:
        padded[a - low : b - low] = text[a:b]
    far = len(item) + width
    first, last = starts or (0, len(text) + 1)
    row = np.where((low + steps >= max(first, 0)) & (low + steps < min(last, len(text) + 1)), 0 if begin is None else abs(low + steps - begin), far)
    for i, c in enumerate(item):
        new = row + (padded[i : i + width] != c)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1, 0
    ends = low + len(item) + steps
    row = np.where((ends >= 0) & (ends <= len(text)), row, far)
    j = int(row.argmin())
    return int(row[j]), int(ends[j])


def distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each end in `text` the least edit distance of `item` to a substring that ends there (bit vectors after Myers)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    last, every = 1 << len(item) - 1, (1 << len(item)) - 1
    plus, minus, d = every, 0, len(item)
    out = np.empty(len(text), np.int64)
    for j, c in enumerate(text.tolist()):
        same = masks.get(c, 0)
        vertical = same | minus
        level = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(level | plus) & every, plus & level
        d += 1 if up & last else -1 if down & last else 0
        up, down = up << 1 & every, down << 1 & every
        plus, minus = down | ~(vertical | up) & every, up & vertical
        out[j] = d
    return out


@dataclass(frozen=True)
class Match:
    item: int
    start: int
    end: int
    edits: int


class GramIndex:
    """The q-grams of a block of items, and the search for the items in texts.

    Items too short for an edit are searched as they are, as whole words: a few letters inside a word are no evidence.
    Where an item may have so many edits that its q-grams prove nothing, an index of grams half as long holds it, down
    to single characters, of which an item always shares some.
    """

    #: A q-gram that this many items share is common. An item may do without its common ones.
    COMMON = 16
    #: Texts are searched together up to this many characters, and longer ones in overlapping parts.
    TOGETHER, PART = 1 << 18, 1 << 20
    #: A text whose hits stand for more places in items than this is halved, the halves overlapping.
    ENTRIES = 2_000_000

    def __init__(self, items: list[str], q: int, error_rate: float) -> None:
        fold = _folded()
        self.q = q
        codes = [fold[_codes(x.replace(_GAP, " "))] for x in items]
        edits = np.array([int(len(x) * error_rate) for x in codes], np.int64)
        fuzzy = np.array([k > 0 and len(x) + 1 > q * (k + 1) for x, k in zip(codes, edits.tolist(), strict=True)], bool)
        self.number = np.flatnonzero(fuzzy)
        self.looser = np.flatnonzero((edits > 0) & ~fuzzy).tolist()
        self.halved = GramIndex([items[i] for i in self.looser], q // 2, error_rate) if self.looser else None
        self.exact: dict[str, list[int]] = {}
        for i in np.flatnonzero(edits == 0).tolist():
            if (text := _text(codes[i])).strip():
                self.exact.setdefault(text, []).append(i)
        self.items = [codes[i] for i in self.number]
        self.edits = edits[fuzzy]
        sizes = np.array([len(x) for x in self.items], np.int64)
        least = sizes - q + 1 - q * self.edits  # q-gram lemma
        own = [grams(x, q) for x in self.items]
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        at = np.concatenate([np.arange(len(x)) for x in own]) if own else np.zeros(0, np.int64)
        # One entry for each item that has a q-gram: the first and the last place, as the gram may repeat.
        order = np.lexsort((at, item, every))
        every, item, at = every[order], item[order], at[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1])
        first = np.flatnonzero(new)
        last = np.append(first, len(every))[1:] - 1
        times = np.diff(np.append(first, len(every)))
        every, item, low, high = every[first], item[first], at[first], at[last]
        # Without some of an item's grams it still shares `least` less as many: half of them may be common ones.
        shared = np.unique(every, return_inverse=True, return_counts=True)
        spread = shared[2][shared[1]] if len(every) else np.zeros(0, np.int64)
        drop = np.zeros(len(every), bool)
        self.least = least.copy()
        for k in np.lexsort((-spread, item)).tolist() if (spread > self.COMMON).any() else ():
            i = item[k]
            if spread[k] > self.COMMON and 2 * (self.least[i] - times[k]) >= least[i]:
                drop[k] = True
                self.least[i] -= times[k]
        every, self.item, self.low, self.high = every[~drop], item[~drop], low[~drop], high[~drop]
        self.keys, self.first = np.unique(every, return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        # A region of an item holds least[i] hits in size + edits places, so one of its windows holds its share of them.
        self.window = int((sizes + self.edits).min()) if len(sizes) else 1
        whole, rest = np.divmod(sizes + self.edits, self.window)
        self.dense = max(1, int(np.min(np.maximum(self.least // (whole + (rest > 0)), (self.least - rest) // whole)))) if len(sizes) else 1
        self.reach = int((sizes + 2 * self.edits).max()) + self.window if len(sizes) else 0
        self.overlap = max(2 * self.reach, max(map(len, self.exact), default=0) + 2)

    def prepare(self) -> None:
        """What each worker makes for itself."""
        if self.halved:
            self.halved.prepare()
        self.fold = _folded()
        self.marked = np.zeros(1 << _BITS, bool)
        self.marked[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.texts = [_text(x) for x in self.items]
        self.automaton = None
        if self.exact:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text in self.exact:
                self.automaton.add_word(text, text)
            self.automaton.make_automaton()

    def search(self, texts: list[str | None]) -> list[list[Match]]:
        """The matches of each text; of overlapping ones of an item, the closest."""
        parts: list[tuple[int, int, str]] = []
        for i, t in enumerate(texts):
            t = (t or "").replace(_GAP, " ")
            step = max(self.PART, 2 * self.overlap)
            for at in range(0, max(len(t) - self.overlap, 1), step):
                parts.append((i, at, t[at : at + step + self.overlap]))
        found: list[list[Match]] = [[] for _ in parts]
        start, size = 0, 0
        for k, (_, _, t) in enumerate(parts):
            size += len(t)
            if size >= self.TOGETHER or k == len(parts) - 1:
                self._search_some([p[2] for p in parts[start : k + 1]], found[start : k + 1])
                start, size = k + 1, 0
        out: list[list[Match]] = [[] for _ in texts]
        for (i, at, _), own in zip(parts, found, strict=True):
            out[i] += [Match(m.item, m.start + at, m.end + at, m.edits) for m in own]
        if self.halved:
            for own, more in zip(out, self.halved.search(texts), strict=True):
                own += [Match(self.looser[m.item], m.start, m.end, m.edits) for m in more]
        return [_best(own) for own in out]

    def _search_some(self, texts: list[str], out: list[list[Match]]) -> None:
        codes = self.fold[_codes(_GAP.join(texts))]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        if self.automaton is not None:
            for d, t in enumerate(texts):
                self._exact(_text(codes[begins[d] : begins[d] + len(t)]), out[d])
        if not len(self.keys):
            return
        h = grams(codes, self.q)
        hits = np.flatnonzero(self.marked[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        key = np.searchsorted(self.keys, h[hits])
        key[key == len(self.keys)] = 0
        true = self.keys[key] == h[hits]
        hits, key = hits[true], key[true]
        if not len(hits):
            return
        # hits in the window that begins at each hit
        after = np.searchsorted(hits, hits + self.window) - np.arange(len(hits))
        dense = hits[after >= self.dense]
        if not len(dense):
            return
        near = np.searchsorted(dense, hits - self.reach)
        keep = (near < len(dense)) & (dense[np.minimum(near, len(dense) - 1)] <= hits + self.reach)
        hits, key = hits[keep], key[keep]
        doc = np.searchsorted(begins, hits, side="right") - 1
        for d in np.unique(doc):
            own = doc == d
            out[d].extend(self._regions(hits[own] - begins[d], key[own], codes[begins[d] : begins[d] + len(texts[d])]))

    def _exact(self, text: str, out: list[Match]) -> None:
        reached: dict[str, int] = {}
        for end, own in self.automaton.iter(text):
            start, end = end + 1 - len(own), end + 1
            inside = (start > 0 and own[0].isalnum() and text[start - 1].isalnum()) or (end < len(text) and own[-1].isalnum() and text[end].isalnum())
            if not inside and start >= reached.get(own, 0):
                reached[own] = end
                out += [Match(i, start, end, 0) for i in self.exact[own]]

    def _regions(self, hits: np.ndarray, key: np.ndarray, text: np.ndarray) -> list[Match]:
        """Count shared q-grams in overlapping bands of diagonals, verify runs of bands that hold enough.

        A band of stride + edits diagonals holds every run of edits + 1 diagonals. A hit counts once in all bands from
        the gram's last place in the item to its first, so a gram that repeats costs no more than another.
        """
        n = self.count[key]
        if n.sum() > self.ENTRIES and len(text) > 4 * self.overlap:
            middle, more = len(text) // 2, self.overlap // 2
            left, right = hits < middle + more, hits >= middle - more
            later = self._regions(hits[right] - middle + more, key[right], text[middle - more :])
            return self._regions(hits[left], key[left], text[: middle + more]) + [Match(m.item, m.start + middle - more, m.end + middle - more, m.edits) for m in later]
        entry = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        at, item = np.repeat(hits, n), self.item[entry]
        edits = self.edits[item]
        if not len(at):
            return []
        stride = edits + 1
        early, late = at - self.high[entry], at - self.low[entry]
        begin = early // stride
        begin -= (early - begin * stride < edits) & (edits > 0)
        end = late // stride + 1
        shift = 1 - int(begin.min())
        places = int(end.max()) + shift + 1
        edge, inverse = np.unique(np.concatenate([item * places + begin, item * places + end]) + shift, return_inverse=True)
        held = np.cumsum(np.bincount(inverse, np.repeat([1, -1], len(item)), len(edge)).astype(np.int64))
        owner = edge // places
        enough = held >= self.least[owner]
        new = enough & ~np.append(False, enough[:-1] & (owner[1:] == owner[:-1]))
        matches: list[Match] = []
        full = _text(text) if new.any() else ""
        for a in np.flatnonzero(new).tolist():
            b = a
            while enough[b]:  # counts fall to 0 behind an item's last band
                b += 1
            i = int(owner[a])
            k = int(self.edits[i])
            bands = [int(edge[x]) - i * places - shift for x in (a, b)]
            self._verify(i, k, bands[0] * (k + 1), (bands[1] - 1) * (k + 1) + 2 * k + 1, text, full, matches)
        return matches

    def _verify(self, i: int, k: int, low: int, high: int, text: np.ndarray, full: str, out: list[Match]) -> None:
        """Matches of item i that start in low .. high - 1: exact ones, then, where those leave room, the closest others."""
        item, size = self.items[i], len(self.items[i])
        number = int(self.number[i])
        low, high = max(low, 0), min(high, len(text) - size + k + 1)
        free, at = [], low
        while at < high:
            exact = full.find(self.texts[i], at, high - 1 + size)
            if exact < 0:
                free.append((at, high))
                break
            out.append(Match(number, exact, exact + size, 0))
            if exact - at >= size - k:  # a match that starts later would overlap the exact one
                free.append((at, exact - size + k + 1))
            at = exact + size
        for a, b in free:
            if b - a <= max(4 * k, size - k):
                d, end = banded_distance(item, text, a - k, b - a + 2 * k, k, starts=(a, b))
                ends = [(d, end)] if d <= k else []
            else:
                d = distances(item, text[a : b + size + k])
                near = np.flatnonzero(d <= k)
                ends = sorted(zip(d[near].tolist(), (a + near + 1).tolist(), strict=True))
            taken: list[tuple[int, int]] = []
            for d, end in ends:
                x = bisect(taken, (end - size + d, len(text)))  # the first that begins behind the latest start of this one
                if (x and taken[x - 1][1] > end - size + d) or (x < len(taken) and taken[x][0] < end):
                    continue
                _, back = banded_distance(item[::-1], text[:end][::-1], -k, 2 * k + 1, k, 0)
                insort(taken, (end - back, end))
                out.append(Match(number, end - back, end, d))


def _best(found: list[Match]) -> list[Match]:
    """Of overlapping matches of one item, the closest, and then the first."""
    kept: list[Match] = []
    taken: dict[int, list[tuple[int, int]]] = {}
    for m in sorted(found, key=lambda m: (m.edits, m.start, m.end, m.item)):
        own = taken.setdefault(m.item, [])
        x = bisect(own, (m.start, m.end))
        if (not x or own[x - 1][1] <= m.start) and (x == len(own) or m.end <= own[x][0]):
            own.insert(x, (m.start, m.end))
            kept.append(m)
    return sorted(kept, key=lambda m: (m.start, m.end, m.item))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, q: int, error_rate: float, block_chars: int) -> Iterator[tuple[list, GramIndex, bool]]:
    """Indexes of at most `block_chars` characters each (or one item), so that what is sent to the tasks has a proven
    bound, and whether there is another to come. An item that repeats is searched once."""
    if not 0 <= error_rate < 1:
        raise ValueError("error_rate is a share of an item's characters, below 1")
    rows = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).filter(F.length("text") > 0).distinct()
    n, count = 1, 2
    while n < 2 * count:
        sized = rows.groupBy(F.pmod(F.xxhash64("text", "item"), F.lit(n)).alias("block")).agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
        most, total, count = sized.agg(F.max("chars"), F.sum("chars"), F.sum("n")).first()
        if not count:
            return
        if most <= block_chars:
            break
        n = max(2 * n, -(-total // block_chars))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == k) if n > 1 else rows
        items = sorted(map(tuple, own.collect()), key=lambda x: (str(x[0]), x[1]))
        if items:
            yield [x[0] for x in items], GramIndex([x[1] for x in items], q, error_rate), n > 1


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, error_rate: float = 0.05, block_chars: int = 4_000_000
) -> DataFrame:
    """Where documents hold a benchmark item with at most error_rate * its length edits.

    Case of A-Z and the kind of white space don't count as edits. Documents are searched whole, in one pass for each
    block of items; nothing is shuffled. With several blocks each pass is stored, so the driver holds one block at a
    time. An item too short for one edit (fewer than 1 / error_rate characters) is found where it stands as whole
    words; blank items are never found.

    Returns a row per match: the document's id, the item's id, start, end (code points) and edits; of overlapping
    matches of one item, the closest, then the first. Null and empty texts match nothing; rows that repeat an id are
    searched each; rows of the benchmark that repeat id and text count once, and null ids of items stay null.
    """
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(item_col, item_type), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])
    names_type = to_arrow_type(item_type)
    out = None
    for names, index, more in _blocks(benchmark, item_col, item_text_col, q, error_rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], names=names, index=index) -> Iterator[pa.RecordBatch]:
            index.prepare()
            for batch in sliced(batches):
                found = [(d, m) for d, own in enumerate(index.search(batch.column(1).to_pylist())) for m in own]
                if found:
                    ids = batch.column(0).take(pa.array([d for d, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([names[m.item] for _, m in found], names_type), *(pa.array([getattr(m, x) for _, m in found], pa.int64()) for x in ("start", "end", "edits"))], schema.names)

        part = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
        part = stored(part) if more else part
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, error_rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of `docs` in which `find_benchmark` finds nothing, with all their columns.

    Rows with a null or empty text stay, and so do repeated rows; without items all rows stay.
    """
    at = docs.columns.index(text_col)
    for _, index, more in _blocks(benchmark, item_col, item_text_col, q, error_rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            index.prepare()
            for batch in sliced(batches):
                clean = [not own for own in index.search(batch.column(at).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        last, docs = docs, docs.mapInArrow(run, docs.schema)
        if more:
            docs = stored(docs)
            discard(last if hasattr(last, "stored_by_pass") else None)
            docs.stored_by_pass = True
    return docs
