"""Scoring by a class-based bigram model (Brown et al.) whose classes are found by exchange clustering."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from fanplume.llm.common import dealt, discard, sliced, stored

#: Absolute discount of each seen word's count; what it frees goes to unseen words of the same class.
DISCOUNT = 0.5


def _pack(x: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(x, 5))


def _unpack(x: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def tokens_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space with A-Z lower-cased; the end token is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def encode_blocks(rows: DataFrame, block_words: int) -> DataFrame:
    """(block, ids, trains, words, blob): documents (id, text, train) of a task as numbers into a vocabulary of their block.

    The blob holds the block's words (as many as `words`) in the order of their numbers, the sizes of its documents and
    all their numbers.
    """
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("trains", T.ArrayType(T.BooleanType())), T.StructField("words", T.LongType()), T.StructField("blob", T.BinaryType())]
    )
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, trains, sizes, numbers = [], [], [], []
        vocabulary: dict[bytes, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, ids, trains, sizes, numbers, vocabulary, held
            blob = _pack((b" ".join(vocabulary), np.array(sizes, np.uint32), np.concatenate(numbers)))
            out = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(id_type)), pa.array([trains], pa.list_(pa.bool_())), pa.array([len(vocabulary)]), pa.array([blob], pa.binary())], schema.names)
            block, ids, trains, sizes, numbers, vocabulary, held = block + 1, [], [], [], [], {}, 0
            return out

        for batch in sliced(batches):
            for i, text, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = tokens_of(text)
                ids.append(i)
                trains.append(bool(train))
                sizes.append(len(words))
                numbers.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.uint32, len(words)))
                held += len(words)
                if held >= block_words or len(ids) >= block_words // 8:
                    yield flush()
        if ids:
            yield flush()

    return rows.select("id", "text", "train").mapInArrow(run, schema)


class Tokens:
    """The documents of a block as numbers of its words, each document followed by the end token, number `end`."""

    def __init__(self, trains: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, end: int) -> None:
        self.sizes = sizes.astype(np.int64) + 1
        self.end = end
        self.tokens = np.full(int(self.sizes.sum()), end, np.int64)
        inner = np.ones(len(self.tokens), bool)
        inner[np.cumsum(self.sizes) - 1] = False
        self.tokens[inner] = numbers
        self.train = np.repeat(trains, self.sizes)

    def before(self, x: np.ndarray, end: int) -> np.ndarray:
        """For each token, the value of x at the one before it, which for the first of a document is the end."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = end
        return out


def buckets_of(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the words by their bucket, the buckets that occur, and where each begins in the order (and the end)."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(own, kind="stable")
    found, edges = np.unique(own[order], return_index=True)
    return order, found, np.append(edges, len(words))


def send_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, blob): the words of each block with their counts in its training text, one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, trains, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "trains", "blob")), strict=True):
                words, sizes, numbers = _unpack(blob)
                words = words.split(b" ") if words else []
                n = np.bincount(numbers[np.repeat(np.array(trains, bool), sizes)], minlength=len(words)).astype(np.uint32)
                order, found, edges = buckets_of(words, buckets)
                blobs = [_pack((b" ".join([words[i] for i in order[a:b].tolist()]), n[order[a:b]])) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    return blocks.select("block", "trains", "blob").mapInArrow(run, "bucket int, block long, blob binary")


NUMBERED = "bucket int, block long, blob binary, stats array<bigint>, top array<struct<word:binary,at:bigint,n:bigint>>"


def number_words(sent: DataFrame, buckets: int, core_words: int) -> DataFrame:
    """Give the words of each bucket numbers and count them over all blocks.

    Rows (bucket, block, blob) hold the numbers and counts of a block's words, in the order in which they were sent.
    One more row a bucket, of no block, holds stats (tokens and different words of the training text) and its most
    frequent words.
    """
    arrow = to_arrow_schema(_schema(NUMBERED))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        place: dict[bytes, int] = {}
        parts = []
        for blob in group.column("blob").to_pylist():
            words, n = _unpack(blob)
            parts.append((np.fromiter((place.setdefault(w, len(place)) for w in words.split(b" ")), np.uint32, len(n)), n))
        total = np.zeros(len(place), np.int64)
        for at, n in parts:
            total[at] += n
        bucket = group.column("bucket")[0].as_py()
        out = [{"bucket": bucket, "block": k, "blob": _pack((at, total[at]))} for k, (at, _) in zip(group.column("block").to_pylist(), parts, strict=True)]
        words = list(place)
        least = np.partition(total, -core_words)[-core_words] if len(total) > core_words else 0
        often = sorted((-int(total[i]), words[i], i) for i in np.flatnonzero(total >= max(least, 1)).tolist())[:core_words]
        out.append({"bucket": bucket, "stats": [int(total.sum()), int((total > 0).sum())], "top": [{"word": w, "at": i, "n": -n} for n, w, i in often]})
        return pa.Table.from_pylist(out, arrow)

    return sent.repartitionById(dealt(buckets), "bucket").groupBy("bucket").applyInArrow(run, NUMBERED)


class Coded(Tokens):
    """A block whose words are known by bucket and number only, ordered by bucket; `seen` tells which training has."""

    def __init__(self, trains: list[bool], blob: bytes) -> None:
        self.found, self.edges, self.at, self.seen, sizes, numbers, self.sums = _unpack(blob)
        super().__init__(np.array(trains, bool), sizes, numbers, len(self.at))

    def keys(self) -> np.ndarray:
        """Bucket and number of each word as one value."""
        return np.repeat(self.found.astype(np.int64), np.diff(self.edges)) << 32 | self.at

    def messages(self, block: int, kind: np.ndarray, classes: int) -> pa.RecordBatch:
        """Rows (bucket, block, blob): the class now, and the counts of classes before and after, of each word of this
        block; and one row with the block's counts of class bigrams. Training text only."""
        total = classes + 2
        x = np.append(kind, classes + 1).astype(np.int64)[self.tokens]
        prev, nxt = self.before(x, classes + 1), np.append(x[1:], 0)
        ask = self.train & (self.tokens < self.end)
        own = self.tokens[ask] * (2 * total)
        pair, count = np.unique(np.concatenate([own + prev[ask], own + total + nxt[ask]]), return_counts=True)
        cells, count = (pair % (2 * total)).astype(np.uint8), count.astype(np.uint32)
        edge = np.searchsorted(pair // (2 * total), np.arange(self.end + 1))
        sizes = np.diff(edge).astype(np.uint32)
        blobs = [_pack((self.at[a:b], kind[a:b], sizes[a:b], cells[edge[a] : edge[b]], count[edge[a] : edge[b]])) for a, b in zip(self.edges, self.edges[1:], strict=False)]
        steps = np.bincount((prev * total + x)[self.train], minlength=total**2).tolist()
        n = len(blobs)
        return pa.RecordBatch.from_arrays(
            [pa.array([*self.found, None], pa.int32()), pa.array([block] * (n + 1), pa.int64()), pa.array([*blobs, None], pa.binary()), pa.array([None] * n + [steps], pa.list_(pa.int64()))], ["bucket", "block", "blob", "steps"]
        )


MESSAGES = "bucket int, block long, blob binary, steps array<bigint>"


def by_block(one: DataFrame, two: DataFrame, tasks: int) -> PandasCogroupedOps:
    """The rows of both by block, dealt to as many tasks as the blocks need; a row is a packed block or a part of one."""
    return one.repartition(dealt(tasks), "block").groupBy("block").cogroup(two.repartition(dealt(tasks), "block").groupBy("block"))


def code_blocks(blocks: DataFrame, numbered: DataFrame, tasks: int, buckets: int, base_of: Callable[[np.ndarray], np.ndarray], ends: int) -> DataFrame:
    """(block, ids, trains, blob): the blocks as `Coded`, with the sums by document that need the words' counts only:
    known tokens, base score, and log10(count - DISCOUNT) over known words."""
    schema = T.StructType([blocks.schema[c] for c in ("block", "ids", "trains", "blob")])
    told = numbered.filter("block IS NOT NULL").select("bucket", "block", "blob")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        at_n = [_unpack(b) for b in right.column("blob").to_pylist()]
        at, n = (np.concatenate([p[k] for p in at_n]) if at_n else np.zeros(0, np.int64) for k in (0, 1))
        blobs = []
        for trains, blob in zip(left.column("trains").to_pylist(), left.column("blob").to_pylist(), strict=True):
            words, sizes, numbers = _unpack(blob)
            order, found, edges = buckets_of(words.split(b" ") if words else [], buckets)
            new = np.empty(len(order), np.uint32)
            new[order] = np.arange(len(order), dtype=np.uint32)
            numbers = new[numbers]
            t = Tokens(np.array(trains, bool), sizes, numbers, len(order))
            count = np.append(n, ends)
            own = np.append(np.where(n > 0, np.log10(np.maximum(n - DISCOUNT, DISCOUNT)), 0.0), 0.0)
            starts = np.cumsum(t.sizes) - t.sizes
            sums = [np.add.reduceat(x[t.tokens], starts) for x in ((count > 0).astype(np.int64), base_of(count), own)]
            blobs.append(_pack((found, edges, at.astype(np.uint32), n > 0, sizes, numbers, sums)))
        return pa.table([left.column("block"), left.column("ids"), left.column("trains"), pa.array(blobs, pa.binary())], schema.names)

    return by_block(blocks.select(*schema.names), told, tasks).applyInArrow(run, schema)


def core_bigrams(coded: DataFrame, core: np.ndarray) -> np.ndarray:
    """Counts of neighbours among the core words (by their keys), all other words (row n) and the end (row n + 1), over all training text."""
    n = len(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n + 2) ** 2, np.int64)
        for batch in batches:
            for trains, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Coded(trains, blob)
                x = np.append(_place(core, np.arange(n), b.keys(), n), n + 1)[b.tokens]
                counts += np.bincount((b.before(x, n + 1) * (n + 2) + x)[b.train], minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    out = np.zeros((n + 2) ** 2, np.int64)
    cells = coded.select("trains", "blob").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()  # at most (n + 2)^2 rows
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n + 2, n + 2)


def _place(core: np.ndarray, values: np.ndarray, keys: np.ndarray, other: int) -> np.ndarray:
    """For each key the value of the core word that has it, or `other`."""
    if not len(core):
        return np.full(len(keys), other, np.int64)
    order = np.argsort(core)
    at = order[np.minimum(np.searchsorted(core, keys, sorter=order), len(core) - 1)]
    return np.where(core[at] == keys, values[at], other)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of the first n words of a (n + 2)^2 bigram matrix by exchange clustering.

    A word at a time is taken out of its class and put where the likelihood of the class bigrams,
    sum N(g, h) log N(g, h) - sum N(g) log N(g) over both sides, grows most; sweeps go on until no word moves.
    Other words and the end keep classes of their own.
    """
    n = len(counts) - 2
    total = classes + 2
    of = np.append(np.arange(n) % classes, [classes, classes + 1])
    member = np.eye(total)[of]
    to, fro = counts @ member, counts.T @ member  # word -> class, class -> word
    between = member.T @ to
    moved = 1
    while moved:  # each move adds to the likelihood, so this ends
        moved = 0
        for w in range(n):
            own, after, back, self_ = of[w], to[w].copy(), fro[w].copy(), counts[w, w]
            # the class bigrams without w
            between[own, :] -= after
            between[:, own] -= back
            between[own, own] += self_
            after[own] -= self_
            back[own] -= self_
            rows, cols = between.sum(1), between.sum(0)
            out, into = after.sum() + self_, back.sum() + self_
            gain = (
                (_xlogx(between + after[None, :]) - _xlogx(between)).sum(1)
                + (_xlogx(between + back[:, None]) - _xlogx(between)).sum(0)
                - _xlogx(rows + out) + _xlogx(rows) - _xlogx(cols + into) + _xlogx(cols)
            )
            d = np.diag(between)
            gain += _xlogx(d + after + back + self_) - _xlogx(d + after) - _xlogx(d + back) + _xlogx(d)
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            after[best] += self_
            back[best] += self_
            between[best, :] += after
            between[:, best] += back
            between[best, best] -= self_
            if best != own:
                of[w] = best
                to[:, own] -= counts[:, w]
                to[:, best] += counts[:, w]
                fro[:, own] -= counts[w, :]
                fro[:, best] += counts[w, :]
                moved += 1
    return of[:n]


def likelihood(steps: np.ndarray) -> float:
    """What a class bigram model gains over a class unigram model, in nats per token."""
    return float((_xlogx(steps).sum() - _xlogx(steps.sum(0)).sum() - _xlogx(steps.sum(1)).sum()) / max(steps.sum(), 1) + np.log(max(steps.sum(), 1)))


def worth_of(steps: np.ndarray) -> np.ndarray:
    """What each class gains from a neighbour; rows: the class before, then the class after."""
    classes = len(steps) - 2
    return np.concatenate([np.log(steps[:, :classes] + 0.5) - np.log(steps.sum(0)[:classes] + 1), np.log(steps[:classes, :].T + 0.5) - np.log(steps.sum(1)[:classes] + 1)])


REPLIES = "bucket int, block long, blob binary, stats array<bigint>"


def choose(messages: DataFrame, buckets: int, steps: np.ndarray) -> DataFrame:
    """Every word of the training text goes to the class that its neighbours' classes favour most, and stays where
    nothing is better.

    Rows (bucket, block, blob) hold the new classes of a block's words, in the order in which they were sent. One more
    row a bucket, of no block, holds stats: tokens by class, words by class, and the tokens of words that moved.
    """
    worth, classes = worth_of(steps), len(steps) - 2
    wide, some = 2 * (classes + 2), 50_000
    arrow = to_arrow_schema(_schema(REPLIES))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        parts = [_unpack(b) for b in group.column("blob").to_pylist()]
        at = np.concatenate([p[0] for p in parts]).astype(np.int64)
        size = int(at.max()) + 1
        old, new, tokens = np.full(size, classes, np.uint8), np.full(size, classes, np.uint8), np.zeros(size, np.int64)
        old[at] = np.concatenate([p[1] for p in parts])
        word = np.repeat(at, np.concatenate([p[2] for p in parts]))
        cell, count = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        order = np.argsort(word, kind="stable")
        word, cell, count = word[order], cell[order], count[order]
        for low in range(0, size, some):
            a, b = np.searchsorted(word, [low, low + some])
            near = np.bincount((word[a:b] - low) * wide + cell[a:b], count[a:b], min(some, size - low) * wide).reshape(-1, wide)
            n = near[:, : classes + 2].sum(1)
            gain = near @ worth
            best = gain.argmax(1)
            own = old[low : low + some].astype(np.int64)
            kept = (own < classes) & (gain[np.arange(len(own)), np.minimum(own, classes - 1)] >= gain.max(1) - 1e-9)
            new[low : low + some] = np.where(n > 0, np.where(kept, own, best), classes)
            tokens[low : low + some] = n
        stats = [np.bincount(new, x, classes + 1)[:classes].astype(np.int64) for x in (tokens, tokens > 0)]
        out = [{"bucket": group.column("bucket")[0].as_py(), "block": k, "blob": new[p[0]].tobytes()} for k, p in zip(group.column("block").to_pylist(), parts, strict=True)]
        out.append({"bucket": out[0]["bucket"], "stats": [*map(int, np.concatenate(stats)), int(tokens[new != old].sum())]})
        return pa.Table.from_pylist(out, arrow)

    return messages.filter("bucket IS NOT NULL").select("bucket", "block", "blob").repartitionById(dealt(buckets), "bucket").groupBy("bucket").applyInArrow(run, REPLIES)


def _summed(df: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of an array column, place by place."""
    out = np.zeros(size, np.int64)
    for r in df.filter(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # as many rows as the array has places
        out[r["at"]] = r["n"]
    return out


def with_classes(coded: DataFrame, replies: DataFrame, tasks: int, make: Callable[[dict, Coded, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What `make` says of each block, given its row and the class of each of its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.frombuffer(b"".join(right.sort_by("bucket").column("blob").to_pylist()), np.uint8)
        made = [make(row, Coded(row["trains"], row["blob"]), kind) for row in left.to_pylist()]
        return pa.Table.from_batches(made) if made else to_arrow_schema(schema).empty_table()

    told = replies.filter("block IS NOT NULL").select("bucket", "block", "blob")
    return by_block(coded, told, tasks).applyInArrow(run, schema)


def learn_classes(coded: DataFrame, tasks: int, buckets: int, core: np.ndarray, of: np.ndarray, classes: int, settled: float, least_gain: float) -> DataFrame:
    """Exchange of all words of the training text, as replies of `choose`.

    Starts from the classes `of` the core words, all others being one class beside them. In each round every word is
    told the classes of its neighbours by the round before, counted over the whole corpus, and the class bigrams are
    counted anew. Rounds end when words with less than the share `settled` of the tokens move, or when the likelihood
    grows by less than `least_gain` nats a token; the likeliest classes stay.
    """
    schema = _schema(MESSAGES)
    total = classes + 2

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, trains, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "trains", "blob")), strict=True):
                b = Coded(trains, blob)
                kind = np.where(b.seen, _place(core, of, b.keys(), classes), classes).astype(np.uint8)
                yield b.messages(block, kind, classes)

    def again(row: dict, b: Coded, kind: np.ndarray) -> pa.RecordBatch:
        return b.messages(row["block"], kind, classes)

    messages = stored(coded.select("block", "trains", "blob").mapInArrow(start, MESSAGES))
    last = replies = None
    before = -np.inf
    while True:
        steps = _summed(messages, "steps", total**2).reshape(total, total).astype(float)
        if replies is not None:
            now = likelihood(steps)
            if now < before + least_gain:
                discard(messages)
                kept, gone = (replies, last) if now > before else (last, replies)
                discard(gone)
                return kept
            before = now
        discard(last)
        last, replies = replies, stored(choose(messages, buckets, steps))
        discard(messages)
        stats = _summed(replies, "stats", 2 * classes + 1)
        if stats[-1] <= settled * stats[:classes].sum():
            discard(last)
            return replies
        messages = stored(with_classes(coded, replies, tasks, again, schema))


@dataclass(frozen=True)
class ClassModel:
    """log10 of P(class | class before) and of P(word | class), less what depends on the word's own count."""

    step: np.ndarray  # (classes + 2)^2: from, to; class `classes` stands for unseen words, `classes + 1` for the end
    size: np.ndarray  # log10 of the tokens of each class, 0 for the last two

    @classmethod
    def of(cls, bigrams: np.ndarray, tokens: np.ndarray, types: np.ndarray, smooth: float = 0.5) -> ClassModel:
        """From counts of class bigrams (unseen words never occur in training), and of tokens and types by class."""
        classes = len(tokens)
        seen = np.append(np.arange(classes), classes + 1)
        own = bigrams.astype(float)
        own[classes, :] = own.sum(0)  # after an unseen word: as often as anywhere
        share = own[:, seen].sum(1, keepdims=True)
        anywhere = (own[classes, seen] + smooth) / (own[classes, seen] + smooth).sum()
        given = (own[:, seen] + smooth * len(seen) * anywhere) / (share + smooth * len(seen))
        free = np.where(tokens > 0, DISCOUNT * types / np.maximum(tokens, 1), 1.0)
        step = np.zeros((classes + 2, classes + 2))
        step[:, seen] = np.log10(given)
        step[:, classes] = np.log10(np.maximum(given[:, :classes] @ free, 1e-300))
        return cls(step, np.append(np.log10(np.maximum(tokens, 1)), [0.0, 0.0]))

    def score(self, classes: np.ndarray, counts: float) -> float:
        """Of a document: the classes of its tokens, and the sum of log10(count - DISCOUNT) over its seen words."""
        before = np.append(len(self.size) - 1, classes[:-1])
        return float(self.step[before, classes].sum() - self.size[classes].sum() + counts)


def score_documents(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", core_words: int = 1000, classes: int = 32, block_words: int = 1_500_000, bucket_words: int = 1_000_000,
    add: float = 0.1, settled: float = 0.01, least_gain: float = 0.01,
) -> DataFrame:
    """The log10 probability of each whole text under a class bigram model, beside a smoothed unigram score.

    Learned from the rows for which `train` holds. Texts are encoded once as numbers into vocabularies of blocks; the
    words of all blocks meet in buckets of about `bucket_words` of them, each block's words in one row a bucket, so a
    word costs a row of a block and no more however often it stands there. Exchange clustering of the `core_words`
    most frequent words on their bigram table is only where the clustering starts; then all words of the training text
    take part in rounds of exchange (see `learn_classes`). A word unseen in training counts as one unknown word, whose
    share each class sets aside.

    Returns a row per row of `docs`: the id, train, n_tokens (with the end token), n_known, train_tokens, base_score
    (sum of log10((count + add) / (N + add * (V + 1)))), score, and perplexity (10 ** (-score / n_tokens)). Null and
    empty texts are the end token alone. Null ids stay null; rows that repeat an id are rows of their own. Where two
    classes are as good, a word stays, or takes the first. Other columns are not returned.
    """
    if classes > 120:
        raise ValueError("a class and its side are told in one byte: 120 classes at most")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = stored(encode_blocks(rows, block_words))
    tasks, words, ends = blocks.agg(F.count("block"), F.sum("words"), F.sum(F.size(F.filter("trains", lambda t: t)))).first()
    tasks, buckets, ends = max(1, tasks), max(1, -(-(words or 0) // bucket_words)), int(ends or 0)
    numbered = stored(number_words(send_words(blocks, buckets), buckets, core_words))
    all_tokens, all_types = _summed(numbered, "stats", 2)
    all_tokens, all_types = int(all_tokens) + ends, int(all_types) + (ends > 0)
    top = numbered.select("bucket", F.explode("top").alias("w")).orderBy(F.desc("w.n"), "w.word").limit(core_words).collect()
    core = np.array([r["bucket"] << 32 | r["w"]["at"] for r in top], np.int64)
    coded = stored(code_blocks(blocks, numbered, tasks, buckets, lambda n: np.log10((n + add) / (all_tokens + add * (all_types + 1))), ends))
    discard(blocks)
    discard(numbered)
    of = exchange(core_bigrams(coded, core).astype(float), classes)
    replies = learn_classes(coded, tasks, buckets, core, of, classes, settled, least_gain)
    stats = _summed(replies, "stats", 2 * classes + 1)
    read = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("train", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "counts")), T.StructField("classes", T.BinaryType())]
    )

    def classed(row: dict, b: Coded, kind: np.ndarray) -> pa.RecordBatch:
        raw = np.append(kind, np.uint8(classes + 1))[b.tokens].tobytes()
        starts = np.cumsum(b.sizes) - b.sizes
        own = [raw[s : s + k] for s, k in zip(starts.tolist(), b.sizes.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(row["ids"], to_arrow_type(read["id"].dataType)), pa.array(row["trains"], pa.bool_()), pa.array(b.sizes), *map(pa.array, b.sums), pa.array(own, pa.binary())], read.names)

    seqs = stored(with_classes(coded, replies, tasks, classed, read))
    discard(coded)
    discard(replies)

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((classes + 2) ** 2, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x = np.frombuffer(raw, np.uint8).astype(np.int64)
                counts += np.bincount(np.append(classes + 1, x[:-1]) * (classes + 2) + x, minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    steps = np.zeros((classes + 2) ** 2)
    for r in seqs.filter("train").select("classes").mapInArrow(stepped, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        steps[r["cell"]] = r["n"]
    model = ClassModel.of(steps.reshape(classes + 2, classes + 2), stats[:classes].astype(float), stats[classes : 2 * classes].astype(float))
    result = T.StructType([T.StructField(id_col, read["id"].dataType), T.StructField("train", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity"))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(np.frombuffer(x, np.uint8).astype(np.int64), c) for x, c in zip(batch.column(6).to_pylist(), batch.column(5).to_pylist(), strict=True)])
            n = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(np.full(len(n), all_tokens)), batch.column(4), pa.array(scores), pa.array(10.0 ** np.minimum(-scores / n, 300.0))], result.names
            )

    return seqs.mapInArrow(scored, result)
