"""Chat formatting, packing and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanplume.llm import chat, packing
from fanplume.llm.queries import QUERIES


def test_conversations_read_back(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = defaultdict(list)
    for c, _, r, t in sorted(turns, key=lambda x: (x[0], x[1])):
        by[c].append((r, t or ""))
    got = {r["conv_id"]: r for r in QUERIES["op2_chat_formatting"](spark, sf).collect()}
    assert set(got) == set(by)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for c, own in by.items():
        said = "".join(t for r, t in own if r == "assistant")
        assert tuple(got[c][1:5]) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(said), sha(said))


def test_template_round_trip():
    t = chat.TurnTemplate()
    turns = [("user", "a\\h </turn>\n### assistant: x </turn>\n"), ("odd: ro#le\n", ""), ("", "\\\\"), ("assistant", " # < \\n ")]
    assert t.parse(t(turns)) == turns
    out, spans, rewritten = chat.locate(t, turns)
    assert rewritten is None and [t.unescape(out[a:b]) for _, _, a, b in spans] == [x for _, x in turns]
    with pytest.raises(ValueError):
        t.parse("### user: x")


def test_templates_with_beginnings_and_endings():
    def render(turns):
        return "<s>" + "".join(f"[{r}]{t}[/{r}]" for r, t in turns) + "</s>"

    turns = [("user", "</s>"), ("assistant", "yes"), ("user", ""), ("assistant", "</s>no")]
    out, spans, rewritten = chat.locate(render, turns)
    assert rewritten is None and [out[a:b] for _, _, a, b in spans] == [x for _, x in turns]
    assert out[spans[1][0] : spans[1][1]] == "[assistant]yes[/assistant]"


def test_templates_that_rewrite_history():
    def last_only(turns):
        """Drops what assistants said before the last turn."""
        return "".join(f"<{r}>{'...' if r == 'assistant' and k < len(turns) - 1 else t}\n" for k, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    out, spans, rewritten = chat.locate(last_only, turns)
    assert rewritten == 2 and out == last_only(turns)
    assert [s and out[s[2] : s[3]] for s in spans] == ["one", None, "three"]
    turns = [("user", "one"), ("assistant", "a longer answer"), ("user", "three"), ("assistant", "the last answer")]
    out, spans, rewritten = chat.locate(last_only, turns)
    assert rewritten == 2 and [s and out[s[2] : s[3]] for s in spans] == ["one", None, "three", "the last answer"]

    def newest_first(turns):
        return "".join(f"<{r}>{t}\n" for r, t in reversed(turns))

    out, spans, rewritten = chat.locate(newest_first, turns)
    assert rewritten == 1 and [out[s[2] : s[3]] for s in spans] == [t for _, t in turns]


def test_rewritten_history_masks_no_foreign_text(spark):
    render = lambda turns: "".join(f"<{r}>{'...' if r == 'assistant' and k < len(turns) - 1 else t}\n" for k, (r, t) in enumerate(turns))
    rows = [(1, 0, "user", "one"), (1, 1, "assistant", "a longer answer"), (1, 2, "user", "three"), (1, 3, "assistant", "the end")]
    (r,) = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), render).collect()
    assert r["rewritten_at"] == 2 and [r["formatted"][x["start"] : x["end"]] for x in r["loss"]] == ["the end"]
    assert [x["text_start"] is None for x in r["turns"]] == [False, True, False, False]


def test_probes_that_the_texts_hold():
    t = chat.TurnTemplate()
    turns = [("\ue000", "\ue000\ue001"), ("assistant", "\ue002"), ("user\ue003", "")]
    out, spans, rewritten = chat.locate(t, turns)
    assert rewritten is None and [out[a:b] for _, _, a, b in spans] == [x for _, x in turns]


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (None, 0, "user", "n"), (2, None, "user", "first"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("own")).withColumn("rows", F.lit(1))
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.collect()}
    template = chat.TurnTemplate()
    assert template.parse(got[1]["formatted"]) == [("", "x"), ("assistant", "")] and template.parse(got[None]["formatted"]) == [("user", "n")]
    assert [t for _, t in template.parse(got[2]["formatted"])] == ["first", "a", "a", "b"]
    assert got[3]["loss"][0]["end"] - got[3]["loss"][0]["start"] == 300_000
    assert chat.digests(out).count() == 4
    assert chat.format_conversations(df.filter("false")).count() == 0


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_pieces(pieces, texts, length=2048):
    """Each document's ids lie whole and in order in its pieces; sequences have no gaps and little padding."""
    ids = dict(zip(texts, reference_ids([t or "" for t in texts.values()]), strict=True))
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by) == set(texts)
    for d, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padding = 0
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= 0.01 * sum(map(len, ids.values()))
    return sequences


def test_packing(spark, sf, rows):
    check_pieces(QUERIES["op3_packing"](spark, sf).collect(), {r[0]: r[1] for r in rows})


def test_packing_of_odd_texts(spark, empty):
    texts = ["", None, " ", "  two  spaces ", "a\n\n b \t c\n", "<|endoftext|> x <|endoftext|>", "it's 'll we'll", "日本 語", "\U0001f600 \U0001f600\U0001f600", "a\x1c b", "word " * 30_000, "x", "x", "﷐ ﷐a", "    z  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("own"))
    out = packing.pack_documents(df, block_tokens=5000).collect()
    check_pieces(out, dict(enumerate(texts)))
    assert all(np.frombuffer(p["ids"], "<u4").size == p["length"] for p in out)
    assert packing.pack_documents(empty).count() == 0


def test_ids_are_those_of_the_library_for_every_code_point():
    own = packing.TextEncoder(packing.vocabulary_path())
    assert own.merges is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    some = [f"a{x}a 1{x}1 .{x}. {x}{x}  {x}\n{x} 'l{x}l" for x in points[:0x3100] + points[0x3100::7]]
    some += ["<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", " " * 300_000 + "x", "ab" * 100_000, "\n \t" * 50_000]
    for at in range(0, len(some), 5000):
        part = some[at : at + 5000]
        assert [[*np.frombuffer(x, "<u4").tolist(), 1] for x in own.encode(part)] == reference_ids(part)


def test_white_space_of_any_length():
    own = packing.TextEncoder(packing.vocabulary_path())
    some = [" " * 5_000_000, "a" + " " * 1_100_000 + "b", "\n" * 2_000_000, "<|endoftext|>" + "\t " * 800_000 + "x"]
    assert [[*np.frombuffer(x, "<u4").tolist(), 1] for x in own.encode(some)] == reference_ids(some)


def test_white_space_of_any_length_through_spark_and_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    texts = [" " * 5_000_000, "word and " * 40 + " " * 1_200_000 + "the end", "other words here " * 30, "\n" * 1_500_000]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    check_pieces(packing.pack_documents(df).collect(), dict(enumerate(texts)))
    spark.createDataFrame([(1, "hello you"), (2, "good day")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = df
    for _, stage in P.STAGES:
        at = stage(spark, at, str(tmp_path))
    assert {r["doc_id"] for r in at.collect()} <= {0, 1, 2, 3}


def test_other_vocabularies_are_left_to_the_library():
    own = packing.TextEncoder(packing.vocabulary_path("word_bpe_49k.json"))
    assert own.merges is None
    assert np.frombuffer(own.encode(["Hello, world"])[0], "<u4").tolist() == own.tokenizer.encode("Hello, world", add_special_tokens=False).ids


def test_repeated_and_null_ids_are_packed(spark, odd):
    pieces = packing.pack_documents(odd, with_ids=False).collect()
    total = sum(len(x) for x in reference_ids([r["text"] or "" for r in odd.collect()]))
    assert sum(p["length"] for p in pieces) == total and None in {p["doc_id"] for p in pieces}


def test_costs_are_balanced():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1500, 2000)
    cost = packing.Cost()
    pieces = packing.pack_block(sizes, 2048, cost)
    spent = defaultdict(float)
    for _, _, n, q, _ in pieces:
        spent[q] += cost.of(n)
    full = [spent[q] for q in spent if sum(n for _, _, n, s, _ in pieces if s == q) == 2048]
    assert np.std(full) / np.mean(full) < 0.2
    whole = np.bincount([d for d, *_ in pieces]) == 1
    assert whole.mean() > 0.7


def test_pipeline(spark, sf, docs, rows):
    import corpus_pipeline as P

    from fanplume.llm import language_id
    from fanplume.llm.common import stored
    from test_dedup import brute_classes, brute_lines

    assert [k for k, _ in P.STAGES] == ["language ID", "line dedup", "near dedup", "benchmark decontamination", "packing"]
    at, seen = docs, {}
    for name, stage in P.STAGES:
        seen[name] = at
        at = stored(stage(spark, at, sf))
        assert name == "packing" or at.columns == docs.columns
    told = language_id.identify(docs, language_id.learn_languages(docs)).filter("NOT rejected").select("doc_id")
    assert {r[0] for r in told.collect()} == {r[0] for r in seen["line dedup"].select("doc_id").collect()}
    assert seen["line dedup"].count() > 0.97 * len(rows)
    before = sorted(map(tuple, seen["line dedup"].select("doc_id", "text").collect()))
    after = {d: t for d, t in seen["near dedup"].select("doc_id", "text").collect()}
    assert after == {d: t for d, t, _, _ in brute_lines(before)}
    kept = {r[0] for r in seen["benchmark decontamination"].select("doc_id").collect()}
    assert kept == {d for d, first, _ in brute_classes(sorted(after.items())) if d == first}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0]: r[1] for r in seen["packing"].select("doc_id", "text").collect()}
    dirty = {d for d in kept if any(x in after[d] for x in items)}
    assert dirty and not dirty & set(clean) and len(clean) >= len(kept) - len(dirty) - 2
    pieces = at.collect()
    check_pieces(pieces, clean)
    whole = P.run(spark, sf)
    check_pieces(whole.collect(), clean)  # partitions may differ, so the pieces may; their documents don't


def test_pipeline_of_odd_tables(spark, odd, empty, clashing, tmp_path):
    """Nulls in any column, repeated rows and extra columns whose names the stages use."""
    import corpus_pipeline as P

    spark.createDataFrame([(1, "an item that no document holds, whatever it says")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [c for c in clashing.columns if c not in odd.columns]
    extra = clashing.select("*", F.lit("own").alias("n_lines2")).drop("kept")
    for table in (odd, extra, empty):
        at = table
        for name, stage in P.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == table.columns, name
        rows = at.collect()
        assert all(r[n] == f"own {n}" for r in rows for n in names if n in at.columns)
        assert {r["doc_id"] for r in rows} <= {1, 2, 3, 7, 8, 9, 10, None} and bool(rows) == (table is not empty)
        assert P.STAGES[-1][1](spark, at, str(tmp_path)).filter("length = 0").count() == 0
