"""Finding files: a listing as a DataFrame, without reading contents.

`scan` sees everything about a mounted folder, errors included; `discover` reads what any store of Spark's lists, with contents
if they are wanted. Both give the same identities, dates (in milliseconds) and sizes.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import extension, filename

from .extract import SOURCE_BYTES
from .folders import listing, look


def identity(volume: Column, path: Column) -> Column:
    """A stable id of a file: the SHA-256 of its volume and path."""
    return F.sha2(F.concat_ws(":", volume, path), 256)


def plain_path(path: str) -> str:
    """A path as listings have it: without a store's name, and without a slash at the end."""
    return "/" + re.sub(r"^[a-z0-9]+:/*(?=/)", "", path).strip("/")


SCANNED = "source_id string, root_id string, path string, filename string, extension string, modified_at timestamp, size long, availability string, kind string, inode string, links long, error string"


def mounted(root: str) -> str | None:
    """The plain path of a root that the machines mount, None for a store's address."""
    scheme = re.match(r"([a-z0-9]+):", root)
    return plain_path(root) if scheme is None or scheme[1] == "file" else None


def scan(spark: SparkSession, root: str, root_id: str = "root", skip: tuple[str, ...] = ()) -> DataFrame:
    """Files, links and errors below a root; kind tells them apart. Stores that aren't mounted give files only."""
    at = mounted(root)
    if at is None:
        return discover(spark, root, root_id).withColumns({"kind": F.lit("file"), **{c: F.lit(None).cast(t) for c, t in (("inode", "string"), ("links", "long"), ("error", "string"))}})
    return _described(listing(spark, at, skip), root_id)


def addresses(root: str, paths: list[str]) -> list[str]:
    """Plain paths below a root as its store has them."""
    store = re.match(r"([a-z0-9]+:(?://[^/]*)?)/", root)
    return [(store[1] if store else "") + p for p in paths]


def _described(rows: DataFrame, root_id: str) -> DataFrame:
    path = F.col("path")
    return rows.select(
        identity(F.lit(root_id), path).alias("source_id"), F.lit(root_id).alias("root_id"), "path", filename(path).alias("filename"), extension(path).alias("extension"),
        F.timestamp_millis("modified_ms").alias("modified_at"), "size", F.when(F.col("placeholder"), "waitingForDownload").otherwise("available").alias("availability"),
        "kind", "inode", "links", "error",
    )


def scan_one(spark: SparkSession, path: str, root: str, root_id: str = "root", policy=None) -> DataFrame:
    """One path looked at again: a row if it is a file below the root that isn't hidden, a link or excluded; else none."""
    rows = spark.createDataFrame([look(os.path.normpath(path))], "path string, kind string, inode string, links long, size long, modified_ms long, placeholder boolean, error string")
    top = F.lit(plain_path(root))
    own = _described(rows, root_id).filter((F.col("kind") == "file") & F.startswith("path", F.concat(top, F.lit("/"))) & ~inside_of(root, F.col("path")).rlike(r"/\."))
    return own if policy is None else own.filter(~policy.excluded(F.col("path"), top))


def discover(spark: SparkSession, root: str, root_id: str = "root", pattern: str | None = None, content: bool = False, paths: list[str] | None = None) -> DataFrame:
    """Files below a folder in any store that Spark reads; hidden ones are skipped, unreadable ones don't fail the listing.

    With `content` the files' bytes come along; files over the size limit come without, and aren't read. With `paths` only
    those files are looked at.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(root if paths is None else [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in addresses(root, paths)])  # names aren't patterns
    if content:
        large = rows.filter(F.col("length") > SOURCE_BYTES).drop("content").withColumn("content", F.lit(None).cast("binary"))
        rows = rows.filter(F.col("length") <= SOURCE_BYTES).unionByName(large)
    path = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    rows = rows.select(path.alias("path"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), *(["content"] if content else [])).filter(~inside_of(root, F.col("path")).rlike(r"/\."))
    return rows.select(
        identity(F.lit(root_id), F.col("path")).alias("source_id"), F.lit(root_id).alias("root_id"), "path", filename(F.col("path")).alias("filename"),
        extension(F.col("path")).alias("extension"), "modified_at", "size", F.lit("available").alias("availability"), *(["content"] if content else []),
    )


def inside_of(root: str, path: Column) -> Column:
    """What of a path is below the root; what is above it doesn't count as hidden."""
    return F.substring(path, F.lit(len(plain_path(root)) + 1), F.length(path))
