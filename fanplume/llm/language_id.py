"""Language identification by compression."""

from __future__ import annotations

from collections import defaultdict

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.llm.common import map_columns

#: ASCII bytes other than letters become spaces; bytes of longer characters stay.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))

MADE = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def normalised(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS)


class CompressionClassifier:
    """One raw-content dictionary a language; the language whose dictionary compresses a text best is predicted.

    Texts are compressed in chunks of `chunk` bytes, so that the dictionary decides over the whole of a long text and
    not only over its beginning.
    """

    def __init__(self, samples: dict[str, bytes], level: int = 6, chunk: int = 2048, min_margin: float = 0.005) -> None:
        self.samples, self.level, self.chunk, self.min_margin = samples, level, chunk, min_margin
        self._ready: dict[str, zstandard.ZstdCompressor] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def _compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if not self._ready:
            for lang in sorted(self.samples):
                content = zstandard.ZstdCompressionDict(self.samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                content.precompute_compress(level=self.level)
                self._ready[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=content, write_content_size=False, write_checksum=False)
        return self._ready

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the margin over the runner-up as a share of its size, and whether that is too narrow.

        `und`, 0 and rejected for a null text, one without letters, and where nothing was learned.
        """
        if not text or not self.samples or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = normalised(text)
        chunks = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(c.compress(x)) for x in chunks), lang) for lang, c in self._compressors().items())
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], margin, margin < self.min_margin


def share_of(sizes: list[int], total: int) -> int:
    """The most bytes that each text may give so that all together give at most `total`; short ones give what they have."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def pieces(data: bytes, size: int, piece: int = 128) -> bytes:
    """About `size` bytes from all over `data`: all of it if it fits, else pieces at equal distances, first and last included."""
    if len(data) <= size:
        return data
    n = max(2, size // (piece + 1))
    own = max(1, size // n - 1)
    return b" ".join(data[at : at + own] for at in ((len(data) - own) * k // (n - 1) for k in range(n)))


def learn_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 160, dictionary_bytes: int = 131072, most_languages: int = 200, **options
) -> CompressionClassifier:
    """Fit a dictionary of about `dictionary_bytes` for each language on a bounded sample of its rows.

    The sample are the `docs_per_language` rows with the smallest hashes of their ids (ties: by id, then by hash of the
    text; a row that repeats id and text counts once). Every sampled text gives the same share of the dictionary, in
    pieces from all over the text; what short texts don't need goes to the others. The pieces are cut where the rows
    lie, so the driver gets the dictionaries only. Rows without an id, a language or a text don't count; an empty table
    teaches nothing. More than `most_languages` languages are an error, since each has a dictionary of its own.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    rows = rows.withColumn("mark", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "mark")
    # A filter on row_number lets every task keep its own best rows only, before anything is shuffled.
    chosen = rows.select("lang", "id", "mark", F.octet_length("text").alias("size")).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_per_language)
    found = chosen.select("lang", "id", "mark", "size").distinct().limit(docs_per_language * most_languages + 1).collect()
    sizes = defaultdict(list)
    for r in found:
        sizes[r["lang"]].append(r["size"])
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not found:
        return CompressionClassifier({}, **options)
    shares = {lang: share_of(own, dictionary_bytes) for lang, own in sizes.items()}
    keys = docs.sparkSession.createDataFrame([(r["lang"], r["id"], r["mark"]) for r in found], T.StructType([rows.schema[c] for c in ("lang", "id", "mark")]))
    texts = rows.join(F.broadcast(keys), ["lang", "id", "mark"]).groupBy("lang", "id", "mark").agg(F.first("text").alias("text"))
    cut = map_columns(texts, ["lang", "text"], [T.StructField("piece", T.BinaryType())], lambda langs, texts: [[pieces(normalised(t), shares[lang]) for lang, t in zip(langs, texts, strict=True)]], drop=["text"])
    learned = defaultdict(list)
    for lang, _, _, piece in sorted(map(tuple, cut.collect()), key=lambda x: (x[0], str(x[1]), x[2])):
        learned[lang].append(bytes(piece))
    return CompressionClassifier({lang: b" ".join(own) for lang, own in learned.items()}, **options)


def identify(docs: DataFrame, model: CompressionClassifier, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to `docs`; columns of those names are replaced, all others pass through.

    Null texts and texts without letters are `und`, 0 and rejected. Where two languages compress a text to the same
    size, the first by name is told, with a score of 0, and rejected. Whole texts are compressed in chunks; repeated
    rows are told the same.
    """

    def fn(texts: list) -> list:
        seen: dict = {}
        for t in texts:
            if t not in seen:
                seen[t] = model.classify(t)
        return [list(x) for x in zip(*(seen[t] for t in texts), strict=True)] if texts else [[], [], []]

    return map_columns(docs, [text_col], MADE, fn)
