"""What there is to fetch: index files of byte offsets, and listings of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One line of an index: a parameter's field of one member, and where it lies in the file.
ENTRY = "param string, type string, number int, _offset long, _length long"
#: A link of a listing, its text, and the size that may follow it behind a date and a time.
LINK = r'<a\b[^<>]*?\bhref="([^"<>]*)"[^<>]*>([^<]*)</a>(?:[\x20\t]+[^\x20\t\n<]+[\x20\t]+[^\x20\t\n<]+[\x20\t]+([0-9]+))?'


def index_entries(lines: DataFrame, by: list[str], line: str = "line") -> DataFrame:
    """The entries of JSON lines by the declared schema, and `problem` where a line isn't one or lacks its place."""
    read = lines.select(*by, F.from_json(line, ENTRY).alias("e")).select(*by, "e.*")
    place = F.col("_offset").isNotNull() & F.col("_length").isNotNull() & (F.col("_offset") >= 0) & (F.col("_length") > 0)
    return read.withColumn("problem", F.when(F.col("param").isNull(), "no entry").when(~place, "no place"))


def incomplete(entries: DataFrame, by: list[str], members: int, kind: str = "pf") -> DataFrame:
    """Of each parameter that a file lists (perturbed members only): how many entries and different members it has, and
    whether each member is there exactly once."""
    own = entries.filter(F.col("problem").isNull() & (F.col("type") == kind)).groupBy(*by, "param")
    found = own.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("number").alias("members"))
    return found.withColumn("complete", (F.col("entries") == members) & (F.col("members") == members))


def byte_ranges(entries: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """The ranges of bytes (first, last) to fetch of each file: those of entries that touch, overlap, or lie at most `gap`
    bytes apart are one. Also how many entries a range serves and how many of its bytes are none of theirs.

    Gaps and islands in one window per file, whose index is a few thousand lines.
    """
    w = Window.partitionBy(*by).orderBy("_offset", "_length")
    behind = F.max(F.col("_offset") + F.col("_length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = entries.filter(F.col("problem").isNull()).withColumn("behind", behind)
    own = own.withColumn("new", (F.col("behind").isNull() | (F.col("_offset") > F.col("behind") + gap)).cast("int"))
    own = own.withColumns({"range": F.sum("new").over(w), "unused": F.when(F.col("new") == 1, 0).otherwise(F.greatest(F.col("_offset") - F.col("behind"), F.lit(0)))})
    found = own.groupBy(*by, "range").agg(F.min("_offset").alias("first"), (F.max(F.col("_offset") + F.col("_length")) - 1).alias("last"), F.count(F.lit(1)).alias("entries"), F.sum("unused").alias("unused"))
    return found.drop("range")


def resolved(link: Column, page: Column) -> Column:
    """A link as an address: whole ones stay, `//host` takes the page's scheme, `/path` its host, `?query` its path, `#part`
    (and nothing) all but its part, and others its folder. Without a whole address of the page the link is missing."""
    scheme, host = F.regexp_extract(page, r"\A([A-Za-z][A-Za-z0-9+.-]*:)//", 1), F.regexp_extract(page, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"\A(.*/)", 1)).otherwise("/")
    out = F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(host, link))
    out = out.when(link.rlike(r"\A[?]"), F.concat(host, path, link)).when((link == "") | link.startswith("#"), F.concat(F.regexp_extract(page, r"\A[^#]*", 0), link)).otherwise(F.concat(host, folder, link))
    return F.when(host != "", out)


def listed(pages: DataFrame, by: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """The links of each page in order (`pos` from 0): the address that they lead to, their text, and the size that a
    listing names behind them, or missing."""
    part = lambda n: F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(n))
    rows = pages.select(*by, F.col(url).alias("__page"), F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("pos", "l"))
    return rows.select(*by, "pos", resolved(F.col("l.a"), F.col("__page")).alias("address"), F.col("l.b").alias("text"), F.nullif(F.col("l.c"), F.lit("")).cast("long").alias("size"))
