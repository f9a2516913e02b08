"""Removal of repeated passages: exact counts of word windows by super-k-mer partitioning."""

from __future__ import annotations

import pickle
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fanplume.llm.common import WordHashes, dealt, map_columns, mix, rolled, sliced, without, words_of

#: Words of a minimiser.
RUN = 5
#: Slots of minimisers per bucket; a slot with more text than a bucket should hold is dealt by window instead. And how
#: many slots are summed at a time.
SLOTS, PART = 64, 4096
#: A slot is dealt by window above this share of the text at most, so the slots that every task has to know are a few
#: millions (8 bytes each) however long the text is.
MOST_HOT = 1_000_000
#: What is told of each super-k-mer of a bucket: number of its owner, first window, a part of its minimiser's hash,
#: whether it repeats in its chunk, and its bytes; and of each single window.
STRINGS, WINDOWS = ("<u4", "<u4", "<u4", "?", "<u4"), ("<u4", "<u4", "<u8", "<u8", "?")


def sliding_argmin(x: np.ndarray, n: int) -> np.ndarray:
    """For each window of `n` elements, the place of its first least one."""
    value, place, size = x, np.arange(len(x)), 1
    while size < n:
        step = min(size, n - size)
        left, right = value[: len(value) - step], value[step:]
        later = right < left
        value, place = np.where(later, right, left), np.where(later, place[step:], place[: len(place) - step])
        size += step
    return place


def super_kmers(hashes: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each run of windows that share a minimiser.

    `hashes` are those of the words of several documents in a row, `doc` tells which word is whose. The minimiser of
    a window is its first least run of RUN words, so equal windows have it at the same place: windows of one
    super-k-mer always differ.
    """
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    runs = rolled(hashes, min(RUN, window))
    place = sliding_argmin(runs, window - min(RUN, window) + 1)
    starts = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    if not len(starts):
        return starts, starts, runs[:0]
    own = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), runs[own[first]]


def merged(ranges: np.ndarray) -> np.ndarray:
    """Sorted ranges (start, end) without overlaps."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.ones(len(ranges), bool)
    new[1:] = ranges[1:, 0] > ends[:-1]
    first = np.flatnonzero(new)
    return np.stack([ranges[first, 0], ends[np.append(first[1:], len(ranges)) - 1]], axis=1)


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def _unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def seal(owners: list[tuple], columns: list[np.ndarray], kinds: tuple[str, ...], text: bytes = b"") -> bytes:
    """Columns of one length (at least one row), side by side and compressed; a blob of one row is hardly more than its text."""
    named = pickle.dumps(owners, 5)
    parts = [struct.pack("<II", len(named), len(columns[0])), named, *(np.ascontiguousarray(c, k).tobytes() for c, k in zip(columns, kinds, strict=True)), text]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unseal(blob: bytes, kinds: tuple[str, ...]) -> tuple[list[tuple], list[np.ndarray], bytes]:
    """What `seal` was given."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size, n = struct.unpack_from("<II", raw)
    at, columns = 8 + size, []
    for k in kinds:
        columns.append(np.frombuffer(raw, k, n, at))
        at += n * columns[-1].itemsize
    return pickle.loads(raw[8 : 8 + size]), columns, raw[at:]


def _equal(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal pairs are neighbours, the number of each one's group in it, and the groups' sizes."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group)


def _ranges(owner: np.ndarray, start: np.ndarray, window: int) -> Iterator[tuple[int, bytes]]:
    """Each owner and the ranges that its windows cover."""
    order = np.argsort(owner, kind="stable")
    owner, start = owner[order], start[order].astype(np.int64)
    edges = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1))
    for a, b in zip(edges, np.append(edges, len(owner))[1:], strict=True):
        yield int(owner[a]), merged(np.stack([start[a:b], start[a:b] + window], axis=1)).astype("<i4").tobytes()


def slot_sums(slot: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots, each once, and the sum of the sizes of each."""
    slots, at = np.unique(slot, return_inverse=True)
    return slots, np.bincount(at, size, len(slots)).astype(np.int64)


def slot_sizes(words: list[list[bytes]], window: int, slots: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the minimisers of a chunk, and the bytes of the different super-k-mers in each."""
    flat = [w for own in words for w in own]
    own = hashes.of(flat)
    first, count, minimiser = super_kmers(own, np.repeat(np.arange(len(words)), [len(w) for w in words]), window)
    if not len(first):
        return (np.zeros(0, np.int64),) * 2
    whole = rolled(own, window)
    told = np.unique(mix(whole[first] + mix(whole[first + count - 1])), return_index=True)[1]
    at = np.cumsum([0, *(len(w) + 1 for w in flat)])
    sizes = (at[first + count + window - 1] - at[first])[told]
    return slot_sums((mix(minimiser[told]) % np.uint64(slots)).astype(np.int64), sizes)


def _together(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[tuple], np.ndarray, list[np.ndarray], bytes]:
    """The owners of all blobs, the number of each row's owner among them, the other columns, and all the text."""
    parts = [unseal(b, kinds) for b in blobs]
    shift = np.cumsum([0] + [len(p[0]) for p in parts])
    index = np.concatenate([p[1][0].astype(np.int64) + s for p, s in zip(parts, shift[:-1], strict=True)])
    return [o for p in parts for o in p[0]], index, [np.concatenate([p[1][k] for p in parts]) for k in range(1, len(kinds))], b"".join(p[2] for p in parts)


def repeated_hashes(blobs: list[bytes], window: int) -> list[tuple[tuple, bytes]]:
    """(owner, ranges) of the windows of a bucket of single windows that more than one chunk told."""
    owners, index, (start, one, two, many), _ = _together(blobs, WINDOWS)
    order, group, sizes = _equal(one, two)
    again = order[(sizes > 1)[group] & ~many[order]]
    return [(owners[d], ranges) for d, ranges in _ranges(index[again], start[again], window)]


class _Chunk:
    """Some documents of a task: their super-k-mers, equal ones told only once.

    Windows whose minimiser is in a `hot` slot go one by one, as 128 bits, to the `spread` buckets after the others.
    """

    def __init__(self, owners: list[tuple], words: list[list[bytes]], window: int, buckets: int, hashes: WordHashes, hot: np.ndarray | None = None, spread: int = 1) -> None:
        self.owners = owners
        sizes = [len(w) for w in words]
        begin = np.cumsum([0, *sizes])
        flat = [w for own in words for w in own]
        doc = np.repeat(np.arange(len(words)), sizes)
        own_hashes = hashes.of(flat)
        first, count, minimiser = super_kmers(own_hashes, doc, window)
        #: (owner, ranges) of windows that occur again within this chunk.
        self.known: list[tuple[tuple, bytes]] = []
        self.blobs: list[tuple[int, bytes]] = []
        if hot is not None and len(hot):
            is_hot = np.isin(mix(minimiser) % np.uint64(buckets * SLOTS), hot)
            if is_hot.any():
                self._windows(own_hashes, first[is_hot], count[is_hot], doc, begin, window, buckets, spread)
            first, count, minimiser = first[~is_hot], count[~is_hot], minimiser[~is_hot]
        at = np.cumsum([0, *map(len, flat)]) + np.arange(len(flat) + 1)
        text = b" ".join(flat)
        cut = [text[a:b] for a, b in zip(at[first].tolist(), (at[first + count + window - 1] - 1).tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        same = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(cut)), np.int64, len(cut))
        repeated = np.bincount(same, minlength=len(cut))[same] > 1 if len(cut) else np.zeros(0, bool)
        owner = doc[first] if len(first) else first
        start = first - begin[owner]
        for d in np.unique(owner[repeated]):
            i = self._of(owner, repeated, d)
            self.known.append((owners[d], merged(np.stack([start[i], start[i] + count[i] - 1 + window], axis=1)).astype("<i4").tobytes()))
        key = mix(minimiser)
        told = np.flatnonzero(same == np.arange(len(cut)))
        bucket = (key[told] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        told, bucket = told[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges, len(bucket))[1:], strict=True):
            i = told[a:b]
            docs, index = np.unique(owner[i], return_inverse=True)
            own = [cut[k] for k in i]
            columns = [index, start[i], key[i] >> np.uint64(32), repeated[i], np.fromiter(map(len, own), np.uint32, len(own))]
            self.blobs.append((int(bucket[a]), seal([owners[d] for d in docs], columns, STRINGS, b"".join(own))))

    def _windows(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, begin: np.ndarray, window: int, buckets: int, spread: int) -> None:
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        one, two = rolled(hashes, window)[at], rolled(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), window)[at]
        order, group, sizes = _equal(one, two)
        at, one, two, many = at[order], one[order], two[order], (sizes > 1)[group]
        owner, start = doc[at], at - begin[doc[at]]
        for d, ranges in _ranges(owner[many], start[many], window):
            self.known.append((self.owners[d], ranges))
        told = np.flatnonzero(np.diff(group, prepend=-1))
        bucket = (one[told] % np.uint64(spread)).astype(np.int64)
        told, bucket = told[np.argsort(bucket, kind="stable")], np.sort(bucket)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges, len(bucket))[1:], strict=True):
            i = told[a:b]
            docs, index = np.unique(owner[i], return_inverse=True)
            self.blobs.append((buckets + int(bucket[a]), seal([self.owners[d] for d in docs], [index, start[i], one[i], two[i], many[i]], WINDOWS)))

    @staticmethod
    def _of(owner: np.ndarray, repeated: np.ndarray, d: int) -> np.ndarray:
        a, b = np.searchsorted(owner, [d, d + 1])  # owners ascend
        return a + np.flatnonzero(repeated[a:b])


def repeated_windows(blobs: list[bytes], window: int) -> list[tuple[tuple, bytes]]:
    """(owner, ranges) of the windows of a bucket that occur twice or more in it.

    Strings of one minimiser are told apart first; windows of those that differ are sorted and counted exactly.
    """
    owners, index, (start, key, many, size), text = _together(blobs, STRINGS)
    ends = np.cumsum(size, dtype=np.int64).tolist()
    strings = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        if b - a < 2:
            continue
        by: dict[bytes, list[int]] = defaultdict(list)
        for i in order[a:b].tolist():
            by[strings[i]].append(i)
        windows = []
        for s, own in by.items():
            whole = len(own) > 1 or bool(many[own[0]])
            at = [0, *(k + 1 for k, c in enumerate(s) if c == 32), len(s) + 1]
            n = len(at) - window
            if whole:
                for i in own:
                    if not many[i]:
                        found[int(index[i])].append((int(start[i]), int(start[i]) + n - 1 + window))
            if len(by) > 1:
                windows += [(s[at[k] : at[k + window] - 1], own[0] if not whole else -1, k) for k in range(n)]
        windows.sort()
        k = 0
        while k < len(windows):
            e = k + 1
            while e < len(windows) and windows[e][0] == windows[k][0]:
                e += 1
            if e - k > 1:
                for _, i, w in windows[k:e]:
                    if i >= 0:
                        found[int(index[i])].append((int(start[i]) + w, int(start[i]) + w + window))
            k = e
    return [(owners[d], merged(np.array(r, np.int64)).astype("<i4").tobytes()) for d, r in found.items()]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_words: int = 1_000_000, bucket_chars: int = 12_000_000) -> DataFrame:
    """Remove every word that lies in a window of `window` words whose sequence starts anywhere else as well.

    Consecutive windows that share a minimiser travel to its bucket as one packed string, about three times the text
    before compression. Equal strings within `chunk_words` words of a task are sent once, so copies and shared
    passages reach a bucket at most once a chunk; buckets are as many as the text needs to hold about `bucket_chars`
    of it each. A pass before sums the strings by slots of minimisers; where a slot has more than `bucket_chars` (or a
    millionth of the text, so that these slots stay few), a
    phrase stands in many surroundings, and its windows are dealt by 128 bits of the whole window, each told once a
    chunk, so that no minimiser fills a bucket. Windows are judged on the input.

    Returns the columns of `docs` with the text replaced by the kept words, joined by one space, plus n_words and
    n_removed; columns of those names are replaced. Words are split at ASCII white space; null texts have none and
    become empty. Rows that repeat an id are documents of their own; so are rows with a null id.
    """
    base = without(docs, ["n_words", "n_removed"])
    rows = base.select(F.col(f"`{id_col}`").alias("id"), F.hash(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_chars))
    id_type = base.schema[id_col].dataType
    sent = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("known", T.BooleanType()), T.StructField("blob", T.BinaryType())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
        owners: list[tuple] = []
        words: list[list[bytes]] = []
        held = 0
        for batch in sliced(batches):
            for i, m, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w = words_of(t)
                if len(w) >= window:
                    owners.append((i, m))
                    words.append(w)
                    held += len(w)
                if held >= chunk_words:
                    yield owners, words
                    owners, words, held = [], [], 0
        if owners:
            yield owners, words

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        told = [slot_sizes(words, window, buckets * SLOTS, hashes) for _, words in chunks(batches)]
        slot, size = slot_sums(*(np.concatenate([t[k] for t in told]) for k in (0, 1))) if told else ((), ())
        if len(slot):
            part, begin = np.unique(slot // PART, return_index=True)
            sums = [_pack((slot[a:b], size[a:b])) for a, b in zip(begin, [*begin[1:], len(slot)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(sums, pa.binary())], ["part", "sums"])

    heavy_chars = max(bucket_chars, total // MOST_HOT)

    def heavy(group: pa.Table) -> pa.Table:
        told = [_unpack(b) for b in group.column("sums").to_pylist()]
        slot, size = slot_sums(*(np.concatenate([t[k] for t in told]) for k in (0, 1)))
        return pa.table([pa.array(slot[size > heavy_chars]), pa.array(size[size > heavy_chars])], ["slot", "size"])

    # the strings are about three times the text, so some 3 * MOST_HOT slots at most have so much
    weighed = rows.mapInArrow(weigh, "part long, sums binary").groupBy("part").applyInArrow(heavy, "slot long, size long").toArrow()
    hot = np.sort(weighed.column("slot").to_numpy()).astype(np.uint64)
    spread = max(1, -(-int(weighed.column("size").to_numpy().sum()) // bucket_chars))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for owners, words in chunks(batches):
            c = _Chunk(owners, words, window, buckets, hashes, hot, spread)
            out = [(b, False, x) for b, x in c.blobs]
            by: dict[int, list] = defaultdict(list)
            for o, r in c.known:
                by[zlib.crc32(str(o).encode()) % buckets].append((o, r))
            out += [(b, True, _pack(x)) for b, x in by.items()]
            b, k, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.bool_()), pa.array(x, pa.binary())], sent.names)

    covered = T.StructType([T.StructField("__fp_id", id_type), T.StructField("__fp_mark", T.IntegerType()), T.StructField("__fp_ranges", T.BinaryType())])

    def count(group: pa.Table) -> pa.Table:
        known, blobs = group.column("known").to_pylist(), group.column("blob").to_pylist()
        found = [x for k, b in zip(known, blobs, strict=True) if k for x in _unpack(b)]
        rest = [b for k, b in zip(known, blobs, strict=True) if not k]
        told_apart = repeated_windows if group.column("bucket")[0].as_py() < buckets else repeated_hashes
        found += told_apart(rest, window) if rest else []
        return pa.table([pa.array([o[0] for o, _ in found], to_arrow_type(id_type)), pa.array([o[1] for o, _ in found], pa.int32()), pa.array([r for _, r in found], pa.binary())], covered.names)

    # a bucket a task: no two meet by chance
    ranges = rows.mapInArrow(partition, sent).repartitionById(dealt(buckets + spread), "bucket").groupBy("bucket").applyInArrow(count, covered)
    ranges = ranges.groupBy("__fp_id", "__fp_mark").agg(F.collect_list("__fp_ranges").alias("__fp_ranges"))
    marked = base.withColumn("__fp_hash", F.hash(F.col(f"`{text_col}`")))
    joined = marked.join(ranges, base[f"`{id_col}`"].eqNullSafe(F.col("__fp_id")) & (F.col("__fp_hash") == F.col("__fp_mark")), "left").drop("__fp_id", "__fp_mark", "__fp_hash")

    def remove(texts: list, ranges: list) -> list:
        kept_texts, n_words, n_removed = [], [], []
        for text, own in zip(texts, ranges, strict=True):
            words = words_of(text)
            kept, at = [], 0
            for a, b in merged(np.frombuffer(b"".join(own), "<i4").reshape(-1, 2)).tolist() if own else ():
                kept += words[at:a]
                at = b
            kept += words[at:]
            kept_texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
        return [kept_texts, n_words, n_removed]

    made = [T.StructField("__fp_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    out = map_columns(joined, [text_col, "__fp_ranges"], made, remove, drop=["__fp_ranges"])
    return out.select(*[(F.col("__fp_text").alias(c) if c == text_col else F.col(f"`{c}`")) for c in base.columns], "n_words", "n_removed")
