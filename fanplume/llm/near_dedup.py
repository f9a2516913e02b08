"""Near-duplicate detection: ProbMinHash signatures, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.llm.common import WordHashes, discard, map_columns, mix, rolled, sliced, stored, without, words_of

#: Registers of a signature, and how many of them make a band: a pair of similarity 0.8 shares no band with
#: probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: A pair whose signatures agree in fewer registers than this share is not verified; 0.8 falls below with probability 2e-5 a test.
LIKELY = 0.62

_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(words: list[bytes], hashes: WordHashes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, sorted, and their weights 1 + ln(count). Fewer words than `size` are one shingle."""
    own = rolled(hashes.of(words), min(size, len(words)))
    shingles, counts = np.unique(own, return_counts=True)
    return shingles, 1.0 + np.log(counts)


def prob_min_hash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """For each register the element whose point in it comes first.

    Each element throws points at random registers at the times of a Poisson process with its weight as the rate.
    Two signatures agree in a register with the probability Jaccard similarity of the weighted sets. Elements stop
    once their time is past the latest of the registers' first times.
    """
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    time = np.zeros(len(elements))
    live = np.arange(len(elements))
    drawn = 0
    with np.errstate(over="ignore"):
        while len(live):
            points = max(1, -(-3 * registers // (2 * len(live))))
            numbers = _STEP * np.arange(drawn + 1, drawn + points + 1, dtype=np.uint64)
            drawn += points
            random = mix(elements[live, None] + numbers)
            waits = -np.log(((random >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[live, None]
            times = np.cumsum(waits, axis=1) + time[live, None]
            time[live] = times[:, -1]
            at = (mix(random ^ _STEP) % np.uint64(registers)).astype(np.int64)
            early = np.flatnonzero(times.ravel() < first.max())
            t, r, e = times.ravel()[early], at.ravel()[early], np.repeat(elements[live], points)[early]
            order = np.argsort(-t, kind="stable")  # the earliest is written last
            new_first, new_owner = np.full(registers, np.inf), np.zeros(registers, np.uint64)
            new_first[r[order]], new_owner[r[order]] = t[order], e[order]
            better = new_first < first
            first, owner = np.where(better, new_first, first), np.where(better, new_owner, owner)
            live = live[time[live] < first.max()]
    return owner


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out * _STEP + rows[:, k])
    return out.astype(np.int64)


def shingle_set(words: list[bytes], hashes: WordHashes, size: int, weighted: bool) -> np.ndarray:
    """The sorted shingles of a text and, if weighted, the bits of their weights after them."""
    elements, weights = weighted_shingles(words, hashes, size)
    return np.append(elements, weights.view(np.uint64)) if weighted else elements


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The sum over shared elements d of 1 / sum over all elements e of max(wa[e] / wa[d], wb[e] / wb[d]).

    In the order of wa / wb, elements from d on give the first of the two and those before it the second. With equal
    weights it is the Jaccard similarity. Rounded to 12 places, so that the order of the sums decides nothing.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(wa[i] / wb[j])
    x, y = wa[i][order], wb[j][order]
    return round(float((1 / ((wa.sum() - np.cumsum(x) + x) / x + (wb.sum() - y.sum() + np.cumsum(y) - y) / y)).sum()), 12)


def similarities(a: np.ndarray, others: list[np.ndarray], weighted: bool) -> np.ndarray:
    """The similarity of one shingle set to each of several."""
    if weighted:
        halves = [np.split(x, 2) for x in (a, *others)]
        (one, w), *rest = [(x, bits.view(np.float64)) for x, bits in halves]
        return np.array([probability_jaccard(one, w, x, v) for x, v in rest])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(a, every), len(a) - 1)
    sizes = np.array([len(x) for x in others])
    both = np.add.reduceat((a[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return both / (len(a) + sizes - both)


def text_key(words: list[bytes]) -> bytes:
    """128 bits that tell texts apart by their words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def signatures(docs: DataFrame, size: int, weighted: bool = False) -> DataFrame:
    """(id, mark, key, bands, signature, shingles) of rows (id, text, mark), the last a count; all but the first two null for a text without words."""
    schema = T.StructType([docs.schema["id"], docs.schema["mark"], T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType()), T.StructField("shingles", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        seen: dict[bytes, tuple] = {}
        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if not words:
                    out.append((None,) * 4)
                    continue
                key = text_key(words)
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    own, weights = weighted_shingles(words, hashes, size)
                    s = prob_min_hash(own, weights if weighted else np.ones(len(own)))  # where links are by sets, repeats must not count
                    seen[key] = (key, band_hashes(s), (s & np.uint64(255)).astype(np.uint8).tobytes(), len(own))
                out.append(seen[key])
            keys, bands, sigs, counts = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(counts, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def components(links: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(key, label) of all keys in `links` (a, b): the least key that is connected to each; and the stored table of it.

    Each round takes the least label of the neighbours, by partial aggregates, and then the label of the label; it
    ends when nothing changes, after about the logarithm of the longest path.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("low")).select("key", F.least("key", "low").alias("label")))
    last = labels
    for _ in range(most_rounds):
        low = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("low"))
        near = labels.join(low, "key").select("key", F.least("label", "low").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("key").alias("near"), F.col("label").alias("far"))
        new = stored(near.join(jump, "near").select("key", F.least("near", "far").alias("label"), (F.least("near", "far") != F.col("old")).alias("moved")))
        settled = not new.filter("moved").limit(1).count()
        discard(last)
        last, labels = new, new.select("key", "label")
        if settled:
            discard(edges)
            return labels, new
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float, weighted: bool) -> DataFrame:
    """The pairs (a, b) whose texts have at least this similarity of shingle sets."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[bytes, np.ndarray] = {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in known:
                if len(known) > 500:
                    known.clear()
                known[key] = shingle_set(words_of(text), hashes, size, weighted)
            return known[key]

        for batch in sliced(batches):
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = [similarities(of(*x), [of(*y)], weighted)[0] >= least for x, y in zip(zip(a, ta, strict=True), zip(b, tb, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _dealt(members: DataFrame, block: int = 4096, block_shingles: int = 8_000_000) -> DataFrame:
    """Members of buckets (h, n, size, key, length, label), each with its own block, and once for each pair of blocks (i, j) it takes part in.

    A bucket of at most `block` members (n) and `block_shingles` shingles (size) is one block. The largest component of
    another one, which most members of a group of copies belong to, has blocks of its own: these meet the blocks of the
    other members but not each other, so a hot group is sent as often as it has blocks of members that it lacks.
    """
    hot = members.filter((F.col("n") > block) | (F.col("size") > block_shingles))
    parts = hot.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    parts = parts.groupBy("h").agg(F.max(F.struct("n", "label", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.greatest(n / block, size / block_shingles))).cast("int")
    rest = blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    parts = parts.select("h", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"), rest.alias("rest"))
    at, is_main = F.xxhash64("key"), F.col("label") == F.col("main")
    own = F.when(is_main, F.col("rest") + F.pmod(at, "mains")).otherwise(F.pmod(at, "rest"))
    last = F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1
    placed = members.join(parts, "h", "left").withColumn("own", F.coalesce(own, F.lit(0)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))))
    return placed.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "label")


def _across(dealt: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """Links (a, b) between members of two blocks (h, i, j, own, key, label, signature, shingles) in different components.

    Pairs whose signatures agree often enough are compared by their shingle sets, the likeliest first. Components that
    a link connects count as one from then on, so a bucket yields fewer links than it has components, and no pairs are
    made.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        key, own = group.column("key").to_pylist(), np.array(group.column("own").to_pylist())
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(key), -1)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        root = np.unique(np.array([x.hex() for x in group.column("label").to_pylist()]), return_inverse=True)[1]
        place = np.arange(len(key))
        found: list[tuple[bytes, bytes]] = []
        for x in place if i == j else np.flatnonzero(own == i):
            rest = np.flatnonzero((root != root[x]) & ((place > x) if i == j else (own == j)))
            if not len(rest):
                continue
            alike = (signature[rest] == signature[x]).mean(axis=1)
            rest, alike = rest[alike >= LIKELY], alike[alike >= LIKELY]
            rest = rest[np.argsort(-alike, kind="stable")]
            while len(rest):
                some, rest = rest[:64], rest[64:]
                for y in some[similarities(sets[x], [sets[y] for y in some], weighted) >= least]:
                    if root[y] != root[x]:
                        found.append((key[x], key[y]))
                        root[root == root[y]] = root[x]
                rest = rest[root[rest] != root[x]]
        return pa.table([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("h", "i", "j").applyInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, weighted: bool = False) -> DataFrame:
    """One row per row of `docs`: its id, class_id (the least id of its class), class_rows (rows in it), text_id (the
    least id of rows with the same words) and class_texts (different texts in the class).

    Classes are the components of links between texts whose sets of `size`-word shingles have a Jaccard similarity
    of at least `least`; with `weighted`, a probability Jaccard similarity in which a shingle's weight is 1 + ln(count).
    Texts with the same words count as one node. Candidates share a band of their ProbMinHash signatures, whose rates
    are these weights, or all the same. In each bucket the members are first tested against the best connected one; then members of
    different components are tested across, in blocks, so no pairs are made within what is connected already.

    Texts of fewer words are one shingle; texts without words (null, empty, blank) are alone in their class. Rows
    that repeat an id and a text are rows of one class. Null ids sort after all others; a class of only such has a
    null class_id. Other columns are not returned.
    """
    sigs = _classes_input(docs, id_col, text_col, size, weighted)
    labels, links = _linked(_rows(docs, id_col, text_col), sigs, size, least, weighted)
    discard(links)
    return _classes(sigs, labels).select(F.col("id").alias(id_col), "class_id", "class_rows", "text_id", "class_texts")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, weighted: bool = False) -> DataFrame:
    """The verified links (a_id, b_id) that connect the classes of `near_duplicates`, by the text_id of both texts, a before b.

    Each is a pair of different texts of at least this similarity; together they connect what any link connects, with
    no more pairs than a bucket has members. Empty tables and texts without words have none; of texts with null ids
    only, the id in the pair is null.
    """
    sigs = _classes_input(docs, id_col, text_col, size, weighted)
    _, links = _linked(_rows(docs, id_col, text_col), sigs, size, least, weighted)
    first = sigs.filter("key IS NOT NULL").groupBy("key").agg(F.min(_rank("id")).alias("first"))
    named = links.join(first.select(F.col("key").alias("a"), F.col("first").alias("one")), "a").join(first.select(F.col("key").alias("b"), F.col("first").alias("two")), "b")
    return named.select(F.least("one", "two")["id"].alias("a_id"), F.greatest("one", "two")["id"].alias("b_id"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def _classes_input(docs: DataFrame, id_col: str, text_col: str, size: int, weighted: bool) -> DataFrame:
    return stored(signatures(_rows(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")), size, weighted))


def _rank(name: str, *more: str):
    return F.struct(F.col(name).isNull().alias("none"), F.col(name).alias("id"), *more)


def _classes(sigs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, key, class_id, class_rows, text_id, class_texts) of all rows."""
    some = sigs.filter("key IS NOT NULL").select("id", "key")
    texts = some.groupBy("key").agg(F.min(_rank("id")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = texts.join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "first", "n")
    classes = texts.groupBy("label").agg(F.min("first").alias("least"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts"))
    named = texts.select("key", "label", "first").join(classes, "label").select("key", F.col("least.id").alias("class_id"), "class_rows", F.col("first.id").alias("text_id"), "class_texts")
    one = F.lit(1).cast("long")
    alone = sigs.filter("key IS NULL").select("id", "key", F.col("id").alias("class_id"), one.alias("class_rows"), F.col("id").alias("text_id"), one.alias("class_texts"))
    return some.join(named, "key").select("id", "key", "class_id", "class_rows", "text_id", "class_texts").union(alone)


def _linked(rows: DataFrame, sigs: DataFrame, size: int, least: float, weighted: bool) -> tuple[DataFrame, DataFrame]:
    """(key, label) of texts with links to others; and the stored links (a, b)."""
    nodes = sigs.filter("key IS NOT NULL").groupBy("key").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("shingles").alias("shingles"), F.min(_rank("id", "mark")).alias("rep"))
    bands = nodes.select("key", F.explode("bands").alias("h"), F.col("shingles").alias("length"))
    counts = bands.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size")).filter("n > 1")
    members = stored(bands.join(counts, "h"))
    degree = members.groupBy("key").agg(F.sum("n").alias("degree"))
    ranked = members.join(degree, "key").select("h", "n", "key", F.struct("degree", "key").alias("weight"))
    centre = ranked.groupBy("h").agg(F.max("weight").alias("centre"))
    stars = members.join(centre, "h").groupBy("key").agg(F.max("centre").alias("centre"))
    pairs = stars.select(F.col("key").alias("a"), F.col("centre.key").alias("b")).filter("a != b")
    needed = members.select("key").distinct().join(nodes.select("key", "rep.id", "rep.mark"), "key").select(F.col("key").alias("want"), F.col("id").alias("rep"), F.col("mark").alias("rep_mark"))
    # by the text's mark too: a null or repeated id has many texts
    marked = rows.withColumn("mark", F.xxhash64("text"))
    found = marked.join(needed, marked["id"].eqNullSafe(needed["rep"]) & (marked["mark"] == needed["rep_mark"])).select("want", "text")
    texts = map_columns(found, ["text"], [T.StructField("key", T.BinaryType())], lambda t: [[text_key(words_of(x)) for x in t]])
    texts = stored(texts.filter("key = want").groupBy("key").agg(F.first("text").alias("text")))
    links = stored(_verified(pairs, texts, size, least, weighted))
    labels, first = components(links)
    marked = stored(members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))
    mixed = marked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("h")

    def shingles(keys: list, texts: list) -> list:
        hashes = WordHashes()
        return [[shingle_set(words_of(t), hashes, size, weighted).tobytes() for t in texts]]

    sets = map_columns(texts, ["key", "text"], [T.StructField("shingles", T.BinaryType())], shingles, drop=["text"])
    parts = _dealt(marked.join(mixed, "h")).join(nodes.select("key", "signature"), "key").join(sets, "key")
    more = stored(_across(parts, least, weighted).distinct())
    if more.limit(1).count():
        links, some = stored(links.unionByName(more)), links
        labels, _ = components(links)
        discard(first)
        discard(some)
    for table in (members, texts, marked, more):
        discard(table)
    return labels, links


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, weighted: bool = False) -> DataFrame:
    """The rows of `docs` that are the first of their class, with all their columns. Rows that repeat id and text are one document."""
    base = without(docs, ())
    sigs = _classes_input(base, id_col, text_col, size, weighted)
    labels, links = _linked(_rows(base, id_col, text_col), sigs, size, least, weighted)
    discard(links)
    first = _classes(sigs, labels).filter(F.col("id").eqNullSafe(F.col("class_id"))).select(F.col("id").alias("__fp_id"), F.coalesce("key", F.lit(b"")).alias("__fp_own")).distinct()
    keyed = map_columns(base, [text_col], [T.StructField("__fp_key", T.BinaryType())], lambda t: [[text_key(w) if w else b"" for w in map(words_of, t)]])
    kept = keyed.join(first, keyed[f"`{id_col}`"].eqNullSafe(first["__fp_id"]) & (F.col("__fp_key") == F.col("__fp_own")), "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
