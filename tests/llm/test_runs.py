"""Periodic runs: Lyndon arrays and runs against brute force, and defined results for odd rows."""

import random

import numpy as np
import pytest

from fanplume.llm.common import WORD
from fanplume.llm.periodic_runs import Equal, find_runs, lyndon_array, runs_of, runs_of_text
from fanplume.llm.queries import ORACLE_SQL, QUERIES


def test_query_equals_sql(same):
    same(QUERIES["op13_periodic_runs"], ORACLE_SQL["op13_periodic_runs"])


def brute_lyndon(s):
    longest = lambda i: max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j)))
    return [longest(i) for i in range(len(s))]


def brute_runs(w, least):
    found = []
    for q in range(1, len(w) // 2 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                length = i - start + q
                if length >= 2 * q and not any(q % p == 0 and a <= start and start + length <= a + m for a, m, p in found):
                    found.append((start, length, q))
                start = None
    return sorted((r for r in found if r[1] >= max(least, 2 * r[2])), key=lambda r: (r[0], r[2]))


def samples(count, most):
    draw = random.Random(5)
    for _ in range(count):
        n, k = draw.randint(0, most), draw.randint(1, 4)
        s = [draw.randrange(k) for _ in range(n)]
        if n and draw.random() < 0.5:
            a, p = draw.randrange(n), draw.randint(1, n)
            s = [s[i] if i < a else s[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(n)]
        yield s


def test_lyndon_arrays_under_both_orders():
    for s in samples(600, 20):
        for signed in (s, [-x for x in s]):
            assert lyndon_array(signed) == brute_lyndon(signed)


def test_lyndon_arrays_of_long_sequences_end():
    for s in ([0] * 50_000, [0, 1] * 25_000, list(range(50_000)), list(range(50_000, 0, -1))):
        assert len(lyndon_array(s)) == 50_000
    assert lyndon_array(list(range(5))) == [5, 4, 3, 2, 1]


def test_extensions():
    for s in samples(200, 40):
        pairs = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s))]
        if not pairs:
            continue
        i, j = (np.array(x) for x in zip(*pairs, strict=True))
        e = Equal(np.array(s))
        ahead = [next((k for k in range(len(s) - b) if s[a + k] != s[b + k]), len(s) - b) for a, b in pairs]
        back = [next((k for k in range(a) if s[a - 1 - k] != s[b - 1 - k]), a) for a, b in pairs]
        assert e.ahead(i, j).tolist() == ahead and e.back(i, j).tolist() == back


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_equal_brute_force(least):
    for s in samples(500, 70):
        assert [tuple(r) for r in runs_of_text([b"%d" % x for x in s], least).tolist()] == brute_runs(s, least)
        if len(s) > 1:
            assert [tuple(r) for r in runs_of(np.array(s), least).tolist()] == brute_runs(s, least)


def brute_row(text, least=12):
    words = WORD.findall(text or "")
    runs = brute_runs(words, least)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def plain(row):
    return row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]


def test_odd_rows(odd, empty, clashing):
    rows = {}
    for r in odd.collect():
        rows.setdefault(r["doc_id"], []).append(r["text"])
    got = {}
    for r in find_runs(odd).collect():
        got.setdefault(r["doc_id"], []).append(plain(r))
    short = {k: v for k, v in rows.items() if k != 7}  # brute force takes the square of a text's length
    assert {k: sorted(got[k]) for k in short} == {k: sorted(map(brute_row, v)) for k, v in short.items()}
    assert got[7][0][0] == 80_000
    assert find_runs(empty).count() == 0
    extra = find_runs(clashing)
    assert extra.columns == [*[c for c in clashing.columns if c != "n_words"], "n_words", "runs", "collapsed"]
    assert sorted(map(str, map(plain, extra.collect()))) == sorted(str(x) for v in got.values() for x in v)


def test_texts_with_runs(spark):
    texts = ["a " * 30, "x " + "a b c " * 5 + "y", "a b " * 7 + "c " + "d e f g h i " * 2 + "d", "a b c d e f " * 2, "a b c d e f a b c d e", None, "", " \t\n", "a b " * 500_000]
    got = {r["doc_id"]: plain(r) for r in find_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: got[k] for k in range(8)} == {k: brute_row(t) for k, t in enumerate(texts[:8])}
    assert got[8] == (1_000_000, [(0, 1_000_000, 2)], "a b")
