"""Line deduplication across documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.llm.common import SPACES, lower_ascii, map_columns, sliced, stored, without

#: How many hashes may be broadcast at most.
HOT = 1000


def line_key(line: str) -> str:
    """What two lines must share to count as one: ASCII white space stripped, A-Z lower-cased."""
    return lower_ascii(line.strip(SPACES))


def _key_hash(line: str, min_chars: int) -> bytes | None:
    key = line_key(line)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")) if len(key) >= min_chars else None


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, except in the document with the smallest id.

    Lines are exploded as 128-bit hashes of their keys, once per document; hash groups are counted with partial
    aggregates, so a line that a third of all documents holds costs each task one row, and the few hottest hashes find
    their lines without a shuffle. The documents that lose lines get the set
    of their hashes back and are put together again by position.

    Returns the columns of `docs` with the text replaced, plus n_lines (before dropping) and n_dropped; columns of
    those names are replaced. Null and empty texts are one empty line and become the empty text. Rows that repeat an
    id are one document. A null id is a document of its own that sorts after all others. Keys shorter than
    `min_chars` code points always stay.
    """
    base = without(docs, ["n_lines", "n_dropped"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = {_key_hash(x, min_chars) for x in text.split("\n")} if text else set()
                own.discard(None)
                ids += [i] * len(own)
                found += own
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(found, pa.binary())], ["id", "mark", "hash"])

    # The mark of its text tells a row from others of one null or repeated id, so no id gathers the lines of many rows.
    mark = F.xxhash64(F.col(f"`{text_col}`"))
    lines = base.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), mark.alias("mark")).mapInArrow(
        hashes, T.StructType([T.StructField("id", base.schema[id_col].dataType), T.StructField("mark", T.LongType()), T.StructField("hash", T.BinaryType())])
    )
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    if min_docs == 2:
        shared = lines.groupBy("hash").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("n")).filter("first != last").drop("last")
    else:
        shared = lines.select("id", "hash").distinct().groupBy("hash").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    shared = stored(shared)
    # At most HOT hashes have more than one in HOT of all shared lines: these are broadcast, the others meet by hash.
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT > total
    told = lines.join(F.broadcast(shared.filter(hot).select("hash", F.col("first").alias("known"))), "hash", "left")
    spread = F.unhex(F.md5(F.concat_ws(" ", "id", "mark")))
    told = told.withColumn("at", F.when(F.col("known").isNull(), F.col("hash")).otherwise(spread))
    told = told.join(shared.filter(~hot).select(F.col("hash").alias("at"), "first"), "at", "left")
    lost = told.filter(rank != F.coalesce("known", "first"))
    lost = lost.groupBy(F.col("id").alias("__fp_id"), F.col("mark").alias("__fp_mark")).agg(F.collect_set("hash").alias("__fp_lost"))
    joined = base.join(lost, base[f"`{id_col}`"].eqNullSafe(F.col("__fp_id")) & (mark == F.col("__fp_mark")), "left").drop("__fp_id", "__fp_mark")

    def rebuild(texts: list, lost: list) -> list:
        kept_texts, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts, lost, strict=True):
            lines = (text or "").split("\n")
            kept = _kept(lines, set(gone), min_chars) if gone else lines
            kept_texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return [kept_texts, n_lines, n_dropped]

    made = [T.StructField("__fp_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    out = map_columns(joined, [text_col, "__fp_lost"], made, rebuild, drop=["__fp_lost"])
    return out.select(*[(F.col("__fp_text").alias(c) if c == text_col else F.col(f"`{c}`")) for c in base.columns], "n_lines", "n_dropped")


def _kept(lines: list[str], gone: set[bytes], min_chars: int) -> list[str]:
    return [x for x in lines if _key_hash(x, min_chars) not in gone]
