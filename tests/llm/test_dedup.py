"""Substring, line and near dedup: against brute force, and defined results for odd rows."""

from collections import Counter, defaultdict

import pytest

from fanplume.llm import line_dedup, near_dedup, substring_dedup
from fanplume.llm.common import SPACES, WORD, lower_ascii
from fanplume.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("key", ["op1_substring_dedup", "op2_chat_formatting", "op4_near_dedup", "op9_line_dedup"])
def test_query_equals_sql(key, same):
    same(QUERIES[key], ORACLE_SQL[key])


def brute_windows(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[s : s + size]) for w in words for s in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {p for s in range(len(w) - size + 1) if seen[tuple(w[s : s + size])] > 1 for p in range(s, s + size)}
        out.append((" ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return out


def test_substrings_of_odd_rows(odd):
    rows = odd.collect()
    got = substring_dedup.dedup_substrings(odd).select("text", "n_words", "n_removed").collect()
    assert Counter(map(tuple, got)) == Counter(brute_windows([r["text"] for r in rows], 35))


@pytest.mark.parametrize("chunk", [40, 10_000])
def test_substrings_with_short_windows_and_small_chunks(spark, chunk):
    texts = ["a a a a a a a a", "x y z a b c d e", "q a b c d e r", "a b c", None, "c d e a b c d e", "é ü ß é ü ß", "b a b a b a b"] * 2 + ["n o n e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for size in (2, 4, 6):
        got = substring_dedup.dedup_substrings(df, window=size, chunk_words=chunk, bucket_chars=20).select("doc_id", "text", "n_words", "n_removed").collect()
        assert {r[0]: tuple(r[1:]) for r in got} == dict(enumerate(brute_windows(texts, size)))


def brute_lines(pairs):
    rank = lambda d: (d is None, d or 0)
    key = lambda x: lower_ascii(x.strip(SPACES))
    held = defaultdict(set)
    for d, t in pairs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(rank(d))
    out = []
    for d, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == rank(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_lines_of_odd_rows(odd):
    got = line_dedup.dedup_lines(odd).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(brute_lines([(r["doc_id"], r["text"]) for r in odd.collect()]))


def test_lines_above_a_threshold(spark):
    df = spark.createDataFrame([(d, "shared by three\nshared by two only" if d < 2 else "shared by three") for d in range(3)], "doc_id long, text string")
    got = line_dedup.dedup_lines(df, min_docs=3).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["shared by three\nshared by two only", "shared by two only", ""]


def jaccard(a, b):
    shingles = lambda t: {tuple(w[s : s + 5]) for w in [WORD.findall(t or "")] for s in range(max(1, len(w) - 4))} if WORD.findall(t or "") else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def classes(rows):
    return Counter((r["doc_id"], r["class_id"], r["class_rows"]) for r in rows)


def brute_classes(pairs):
    label = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if jaccard(pairs[i][1], pairs[j][1]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    rank = lambda d: (d is None, d or 0)
    first = {x: min((pairs[i][0] for i in range(len(pairs)) if label[i] == x), key=rank) for x in set(label)}
    return Counter((pairs[i][0], first[label[i]], label.count(label[i])) for i in range(len(pairs)))


def test_near_classes_of_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert classes(got) == brute_classes([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_near_classes_without_a_common_centre(spark):
    """A chain: each text is like the next but not like those further on; and many near copies of one."""
    base = [f"w{i}" for i in range(100)]
    chain = [base[: 100 - 8 * k] + [f"x{k}{i}" for i in range(4 * k)] for k in range(5)]
    copies = [[*base[:50], f"edit{k}", *base[51:]] + ["tail"] * (k % 3) for k in range(40)]
    texts = [" ".join(w) for w in chain + copies]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert classes(near_dedup.near_duplicates(df).collect()) == brute_classes(list(enumerate(texts)))


def test_links_connect_what_the_classes_hold(spark, odd):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[: 100 - 8 * k] + [f"x{k}{i}" for i in range(4 * k)]) for k in range(5)] + [" ".join([*base[:50], f"edit{k % 9}", *base[51:]]) for k in range(20)] + ["alone", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = [tuple(r) for r in near_dedup.near_links(df).collect()]
    assert links and all(a < b and texts[a] != texts[b] and jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    label = {i: i for i in rows}
    for a, b in links:
        label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    for i, r in rows.items():
        same = [j for j in rows if texts[i] and texts[j] and texts[i].split() == texts[j].split()] or [i]
        assert r["text_id"] == min(same) and label[r["text_id"]] == r["class_id"]
        assert r["class_texts"] == len({x["text_id"] for x in rows.values() if x["class_id"] == r["class_id"]})
    for r in near_dedup.near_duplicates(odd).collect():
        assert r["class_texts"] <= r["class_rows"]
    near_dedup.near_links(odd).collect()


def test_one_of_each_class_stays(odd):
    got = near_dedup.drop_near_duplicates(odd).collect()
    ids = Counter(r["doc_id"] for r in got)
    assert ids == Counter([1, 4, 5, 6, None, 7, 8, 9, 9, 10]) and got[0].__fields__ == odd.columns
    assert [r["text"] for r in got if r["doc_id"] is None] == ["alone here"]


def test_signatures_estimate_similarity():
    import numpy as np

    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
    agree = [(near_dedup.prob_min_hash(a + np.uint64(k), np.ones(1000)) == near_dedup.prob_min_hash(b + np.uint64(k), np.ones(1000))).mean() for k in range(0, 100_000, 2000)]
    assert abs(np.mean(agree) - 800 / 1200) < 0.03
    weights = np.where(np.arange(1000) < 500, 5.0, 1.0)
    heavy = near_dedup.prob_min_hash(a, weights, 4096)
    assert abs((heavy <= 500).mean() - 5 / 6) < 0.03
    assert (near_dedup.prob_min_hash(a[:1], np.ones(1)) == 1).all()


@pytest.mark.parametrize("op", [substring_dedup.dedup_substrings, line_dedup.dedup_lines, near_dedup.near_duplicates, near_dedup.drop_near_duplicates])
def test_empty_tables(op, empty):
    assert op(empty).count() == 0


def test_clashing_columns(clashing, odd):
    lines = line_dedup.dedup_lines(clashing)
    assert set(lines.columns) == set(clashing.columns) and lines.schema["n_lines"].dataType.simpleString() == "bigint"
    assert lines.filter("hash <> 'own hash'").count() == 0 and lines.count() == odd.count()
    words = substring_dedup.dedup_substrings(clashing)
    assert words.count() == odd.count() and words.schema["n_words"].dataType.simpleString() == "bigint"
    near = near_dedup.drop_near_duplicates(clashing)
    assert near.columns == clashing.columns and near.filter(F.col("key") != "own key").count() == 0
    assert near_dedup.near_duplicates(clashing).count() == odd.count()


@pytest.mark.parametrize("known", [1, 10])
@pytest.mark.parametrize("block", [3, 4096])
def test_components_of_a_bucket_are_tested_across_in_blocks(spark, block, known):
    """`known` of them are one component from the start."""
    from fanplume.llm.common import WordHashes, words_of

    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(2, 40, 2)] + [" ".join(f"z{i}" for i in range(80))]
    rows = []
    for t in texts:
        shingles, weights = near_dedup.weighted_shingles(words_of(t), WordHashes())
        key = near_dedup.text_key(words_of(t))
        low = (near_dedup.prob_min_hash(shingles, weights) & near_dedup.np.uint64(255)).astype("u1").tobytes()
        mine = key if len(rows) >= known or not rows else rows[0][3]
        rows.append((1, len(texts), 76 * len(texts), bytearray(key), 76, bytearray(mine), bytearray(low), bytearray(shingles.tobytes())))
    members = spark.createDataFrame(rows, "h long, n long, size long, key binary, length long, label binary, signature binary, shingles binary")
    dealt = near_dedup._dealt(members, block)
    assert known < 10 or block > 3 or dealt.groupBy("key").count().filter(F.col("count") > 4).count() <= len(texts) - known
    links = near_dedup._across(dealt.join(members.select("key", "signature", "shingles"), "key"), 0.8).collect()
    keys = {bytes(r[3]): i for i, r in enumerate(rows)}
    label = [0 if i < known else i for i in range(len(texts))]
    for a, b in ((keys[bytes(x["a"])], keys[bytes(x["b"])]) for x in links):
        assert jaccard(texts[a], texts[b]) >= 0.8
        label = [label[b] if x == label[a] else x for x in label]
    want = brute_classes(list(enumerate(texts)))
    assert Counter(label.count(x) for x in label) == Counter({n: k for (_, _, n), k in Counter((0, 0, n) for _, _, n in want).items()})
    assert block == 3 or len(links) < len(texts)


def test_near_copies_whose_own_passages_repeat(spark):
    texts = []
    for k in range(30):
        shared = [f"{k}s{i}" for i in range(84)]
        texts += [" ".join(shared), " ".join(shared + [f"{k}own{i}" for i in range(14)] * 60)]
        assert jaccard(*texts[-2:]) >= 0.8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert classes(near_dedup.near_duplicates(df).collect()) == brute_classes(list(enumerate(texts)))


@pytest.mark.parametrize("same_id", [None, 7])
def test_texts_of_one_id_are_not_joined_with_each_other(spark, monkeypatch, same_id):
    texts = [" ".join([f"{k // 2}s{i}" for i in range(60)] + ["end"] * (k % 2)) for k in range(40)]
    df = spark.createDataFrame([(same_id, t) for t in texts], "doc_id long, text string")
    fetched = []

    def counting(rows, *args, **kwargs):
        if rows.columns == ["want", "text"]:
            fetched.append(rows.count())
        return plain(rows, *args, **kwargs)

    plain = near_dedup.map_columns
    monkeypatch.setattr(near_dedup, "map_columns", counting)
    got = near_dedup.near_duplicates(df).collect()
    assert fetched == [40] and [r["class_rows"] for r in got] == [2] * 40


@pytest.mark.parametrize("chunk_words", [400, 1_000_000])
def test_a_phrase_in_many_surroundings_fills_no_bucket(spark, chunk_words):
    from fanplume.llm.common import WordHashes, words_of

    phrase = [f"p{i}" for i in range(20)]
    texts = [" ".join([*(f"{k // 3 if k % 3 < 2 else k}a{i}" for i in range(40)), *phrase, *(f"{k}b{i}" for i in range(40))]) for k in range(120)] + ["short", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.dedup_substrings(df, chunk_words=chunk_words, bucket_chars=6000).orderBy("doc_id").collect()
    assert [(r["text"], r["n_words"], r["n_removed"]) for r in got] == brute_windows(texts, 35)

    words, buckets = [words_of(t) for t in texts[:120]], 12
    slots, sizes = substring_dedup.slot_sizes(words, 35, buckets * substring_dedup.SLOTS, WordHashes())
    hot = slots[sizes > 6000].astype("u8")
    assert len(hot)
    chunk = substring_dedup._Chunk([(k, 0) for k in range(120)], words, 35, buckets, WordHashes(), hot, 16)
    assert max(len(substring_dedup.unseal(x, substring_dedup.STRINGS)[2]) for b, x in chunk.blobs if b < buckets) < sizes.max()
    single = [len(substring_dedup.unseal(x, substring_dedup.WINDOWS)[1][0]) for b, x in chunk.blobs if b >= buckets]
    assert len(single) == 16 and max(single) < 2 * sum(single) / 16


def test_a_string_alone_in_its_bucket_costs_little(rows):
    from fanplume.llm.common import WordHashes, words_of

    words = [w for r in rows if len(w := words_of(r[1])) >= 35]
    told = [substring_dedup._Chunk([(k, k) for k in range(len(words))], words, 35, buckets, WordHashes()).blobs for buckets in (1, 2**30)]
    text = sum(len(substring_dedup.unseal(x, substring_dedup.STRINGS)[2]) for _, x in told[0])
    strings = sum(len(substring_dedup.unseal(x, substring_dedup.STRINGS)[1][0]) for _, x in told[0])
    apart = sum(len(x) for _, x in told[1])
    assert len(told[1]) > 0.8 * strings and sum(len(substring_dedup.unseal(x, substring_dedup.STRINGS)[2]) for _, x in told[1]) == text
    assert apart < text  # with the numbers that go along


def test_sealed_columns_come_back():
    import numpy as np

    owners, columns = [(7, -1), (None, 2), ("é", 3)], [np.array([0, 2, 1]), np.array([5, 2**32 - 1, 0]), np.array([1, 2, 3], np.uint64), np.array([True, False, True]), np.array([1, 0, 3])]
    names, back, text = substring_dedup.unseal(substring_dedup.seal(owners, columns, substring_dedup.STRINGS, b"abcd"), substring_dedup.STRINGS)
    assert names == owners and text == b"abcd" and [x.tolist() for x in back] == [x.tolist() for x in columns]


def weighted_jaccard(a, b):
    """By its definition."""
    from math import log

    x, y = ({g: 1 + log(n) for g, n in Counter(tuple(w[s : s + 5]) for w in [WORD.findall(t)] for s in range(len(w) - 4)).items()} for t in (a, b))
    every = x.keys() | y.keys()
    return round(sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x.keys() & y.keys()), 12)


def test_weighted_classes_are_by_probability_jaccard(spark, monkeypatch):
    import random

    rng = random.Random(5)
    texts = []
    for k in range(25):
        shared = [f"{k}s{i}" for i in range(60)]
        for more in (0, 8, 14):
            own = [f"{k}own{more}{i}" for i in range(more)]
            texts.append(" ".join(shared * rng.choice([1, 3]) + own * rng.choice([1, 2, 9])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, weighted = (classes(near_dedup.near_duplicates(df, weighted=w).collect()) for w in (False, True))
    assert plain == brute_classes(list(enumerate(texts)))
    monkeypatch.setitem(globals(), "jaccard", weighted_jaccard)
    assert weighted == brute_classes(list(enumerate(texts))) and weighted != plain
