"""The labels of a table's dimensions, gathered once and stored, so that a question about a part of it reads that part alone."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanplume.sources.shared import shared_folder


def stored_axes(spark: SparkSession, path: str, name: str, cells: DataFrame, dims: list[str]) -> DataFrame:
    """One row with an array of the labels of each dimension that occur in `cells`, which are read from the table at `path`.

    The first call for a state of the table (path, number and size of its files, time of its last change) gathers them
    by partial aggregates over all of it and stores the row in the shared folder; later ones read the row. `name`
    tells apart what else the cells depend on. Labels of a dimension are few by nature: models, members, hours. Two
    jobs that gather at the same time store equal rows, and the first one stays.
    """
    hadoop, folder = spark._jvm.org.apache.hadoop.fs.Path, shared_folder(spark)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    table = hadoop(path)
    fs = table.getFileSystem(conf)
    size, changed = fs.getContentSummary(table), fs.getFileStatus(table).getModificationTime()
    state = "\0".join(map(str, (path, name, *dims, size.getLength(), size.getFileCount(), changed)))
    at = f"{folder}/axes-{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    kept = hadoop(at)
    store = kept.getFileSystem(conf)
    labels = cells.agg(*(F.collect_set(d).alias(d) for d in dims))
    if not store.exists(kept):
        own = f"{at}-{uuid.uuid4().hex}"
        labels.coalesce(1).write.parquet(own)
        if store.exists(kept) or not store.rename(hadoop(own), kept):
            store.delete(hadoop(own), True)
    return spark.read.schema(labels.schema).parquet(at)
