"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fanplume.sources.shared import new_path

#: What separates words and what is stripped from lines: space, tab, \n, \v, \f, \r.
SPACES = " \t\n\x0b\x0c\r"
#: Tasks of one shuffle, at most; beyond them each task takes several buckets in turn.
MOST_TASKS = 50_000
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower_ascii(text: str) -> str:
    """`text` with A-Z lower-cased and every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of `text`, split at `SPACES` only (bytes.split() knows just these six); none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the folder that driver and executors share and read back, which cuts its lineage.

    Unlike cached or locally checkpointed data, the table outlives any executor.
    """
    path = new_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what `stored` wrote for `df`, once all that was made from it has been stored in turn."""
    if df is not None:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def dealt(tasks: int) -> int:
    """How many tasks a shuffle is dealt to that would want so many: one at least, and no more than a driver keeps track of."""
    return max(1, min(tasks, MOST_TASKS))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less the columns that an operator is about to add under the same names."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few of them are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_columns(df: DataFrame, inputs: list[str], made: list[T.StructField], fn: Callable[..., list], drop: Iterable[str] = ()) -> DataFrame:
    """Add columns computed from each Arrow batch; the others pass through untouched.

    `fn` gets the Python values of the `inputs` columns and returns one list per field of `made`. A column of `df`
    that has the name of a made one is replaced; those in `drop` are left out.
    """
    gone = {f.name.lower() for f in made} | {n.lower() for n in drop}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    at = [df.columns.index(c) for c in inputs]
    types = to_arrow_schema(T.StructType(made)).types
    names = [df.columns[i] for i in kept] + [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            new = fn(*(batch.column(i).to_pylist() for i in at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(v, t) for v, t in zip(new, types, strict=True)], names)

    return df.mapInArrow(run, T.StructType([df.schema.fields[i] for i in kept] + made))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): spreads the bits of each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when `most` are held so that memory stays bounded."""

    def __init__(self, most: int = 400_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` consecutive elements."""
    if len(hashes) < n:
        return hashes[:0]
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
