"""The journal of vectors: lines of JSON that are only ever added, each with its payload of half floats and a checksum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.maintenance import latest

LINE = "key long, seq long, tombstoned boolean, payload binary, sha256 string"


def half(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian half floats."""
    return pd.Series([None if v is None else np.asarray(v, "<f2").tobytes() for v in vectors])


def append(rows: DataFrame, path: str) -> None:
    """Add a line for each row(key, seq, tombstoned, embedding). Tombstones carry no payload."""
    data = F.pandas_udf(half, "binary")(F.when(~F.col("tombstoned"), F.col("embedding")))
    line = rows.select("key", "seq", "tombstoned", data.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    line.select(F.to_json(F.struct("key", "seq", "tombstoned", F.base64("payload").alias("payload"), "sha256")).alias("value")).write.mode("append").text(path)


def replay(spark: SparkSession, path: str, snapshot: DataFrame | None = None) -> DataFrame:
    """key, seq, tombstoned, embedding after all lines: of each key the last one.

    Lines that can't be read, or whose payload doesn't match its checksum, are passed over. A snapshot(key, seq, tombstoned,
    embedding) stands before the lines.
    """
    x = spark.read.text(path).select(F.from_json("value", LINE, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
    good = F.col("key").isNotNull() & F.col("seq").isNotNull() & (F.col("tombstoned") | F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)))

    @F.pandas_udf("array<float>")
    def whole(payloads: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else np.frombuffer(p, "<f2").astype(np.float32) for p in payloads])

    rows = x.filter(good).select("key", "seq", "tombstoned", whole("payload").alias("embedding"))
    rows = rows if snapshot is None else rows.unionByName(snapshot)
    return latest(rows, ["key"], [F.desc("seq")])
