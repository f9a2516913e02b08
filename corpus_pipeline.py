"""A training corpus from the table documents: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.llm.common import stored, table
from fanplume.llm.decontaminate import decontaminate
from fanplume.llm.language_id import identify, learn_languages
from fanplume.llm.line_dedup import dedup_lines
from fanplume.llm.near_dedup import drop_near_duplicates
from fanplume.llm.packing import pack_documents


def _aside(docs: DataFrame, names: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `stage` makes of `docs`, with their columns only; those under names that it adds keep what they hold."""
    own = {c: f"__own_{c}" if c.lower() in names else c for c in docs.columns}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]))
    return out.select(*[F.col(f"`{x}`").alias(c) for c, x in own.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or whose best two languages compress them about equally
    well, go; long texts are judged whole, repeated rows alike, and an empty table stays empty."""

    def told(rows: DataFrame) -> DataFrame:
        return identify(rows, learn_languages(rows)).filter("NOT rejected")

    return _aside(docs, ("lang_pred", "score", "rejected"), told)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them only; n_chars follows the text.

    No row goes: null texts become empty, rows that repeat an id are one document, a null id comes last."""

    def fewer(rows: DataFrame) -> DataFrame:
        out = dedup_lines(rows)
        return out.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType)) if "n_chars" in rows.columns else out

    return _aside(docs, ("n_lines", "n_dropped"), fewer)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays (rows that repeat id and text are one
    document). Documents without words stay, whatever they are like."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without items, all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences that hold all tokens of what is left; null and empty texts are an end token."""
    return pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Not expressible: trained models, approximate matching and tokenizers are beyond SQL. Tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each but the last is stored in the shared folder before the next one reads it.

    All columns of documents go through the first four stages unchanged, but for text and n_chars; an empty table
    gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
