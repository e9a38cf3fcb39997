"""Vectors: cosine similarity, exact and approximate nearest neighbours, lanes and their fusion, upkeep of a snapshot."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of ranking and upkeep.
RRF = 60
REBUILD_COUNT, REBUILD_SHARE = 10_000, 0.05
CANDIDATES, CANDIDATES_FILTERED = 500, 1000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def cosine_to(query: list[float]):
    """`cosine` to one vector as an Arrow UDF, for many rows: a component at a time, so a row's sums don't depend on the others of its batch, as a matrix product's do, and are exact for whole numbers. Equal scores are equal to the last digit, and ties are ties."""
    q = np.asarray(query, np.float64)
    length = np.sqrt(sum(float(x) * float(x) for x in q))

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        components = np.ascontiguousarray(np.stack(vectors.to_numpy()).T, np.float64)
        if len(components) != len(q):
            raise ValueError(f"a vector of {len(q)} components can't be compared with those of {len(components)}")
        dots, squares = np.zeros(len(vectors)), np.zeros(len(vectors))
        for x, y in zip(components, q):
            dots += x * y
            squares += x * x
        n = np.sqrt(squares) * length
        return pd.Series(np.divide(dots, n, out=np.zeros(len(n)), where=n > 0))

    return run


def similarities(queries: DataFrame, vectors: DataFrame, rows: int = 4_096, at_once: int = 256) -> DataFrame:
    """a, b, score for each query and each row of vectors(key, embedding): both are dealt into blocks, and each pair of blocks is a task's group."""
    number = lambda df, size: max(1, -(-df.count() // size))
    n, m = number(vectors, rows), number(queries, at_once)
    block = lambda count: F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = [F.col("key").cast("long").alias("key"), F.col("embedding").alias("embedding")]
    x = vectors.select(*own, block(n).alias("i"), every(m).alias("j"))
    q = queries.select(*own, block(m).alias("j"), every(n).alias("i"))

    def unit(table: pa.Table) -> np.ndarray:
        v = np.stack(table.column("embedding").to_numpy()).astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    def products(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = right.column("key").to_numpy(), left.column("key").to_numpy()
        return pa.table({"a": np.repeat(a, len(b)), "b": np.tile(b, len(a)), "score": (unit(right) @ unit(left).T).reshape(-1)})

    return x.groupBy("i", "j").cogroup(q.groupBy("i", "j")).applyInArrow(products, "a long, b long, score double")


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def exact_top(vectors: DataFrame, query: list[float], k: int, tie: str = "key") -> DataFrame:
    """The k most similar rows; ties by key."""
    return vectors.withColumn("score", cosine(F.col("embedding"), literal(query))).orderBy(F.desc("score"), tie).limit(k)


def merge(snapshot: DataFrame, delta: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """Matches (key, score) of both, only active keys, the better score for each."""
    both = snapshot.unionByName(delta).join(active.select("key"), "key", "left_semi")
    return both.groupBy("key").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "key").limit(k)


def int8(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127).cast("int"))))


def normalise(vector: Column) -> Column:
    n = norm(vector)
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def rebuild_needed(snapshot: Column, added: Column, removed: Column) -> Column:
    """Whether what was added to or removed from a snapshot calls for a new one."""
    many = lambda n: (n > 0) & ((n >= REBUILD_COUNT) | (n >= snapshot * REBUILD_SHARE))
    return many(added) | many(removed)


def semantic_search(matches: DataFrame, passages: DataFrame, where: Column, images: bool, limit: int) -> DataFrame:
    """matches(passage_id, score) joined to their passages and filtered; a source's best passage is its score. Pictures only where asked for."""
    rows = passages.join(F.broadcast(matches), "passage_id").filter(where if images else where & (F.col("location_kind") != "image"))
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "passage_id")
    best = rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return best.select("source_id", "passage_id", "score").orderBy(F.desc("score"), "source_id").limit(limit)


def fuse(lexical: DataFrame, semantic: DataFrame, weight: float, limit: int, exact: Column | None = None) -> DataFrame:
    """Weighted reciprocal ranks of two lists (source_id, position from 1). Sources for which `exact` holds, of the first list's columns, come first."""
    a = lexical.select("source_id", F.col("position").alias("lexical"), (F.lit(False) if exact is None else exact).alias("exact"))
    b = semantic.select("source_id", F.col("position").alias("semantic"))
    share = lambda w, c: F.coalesce(F.lit(w) / (RRF + F.col(c)), F.lit(0.0))
    score = share(1 - weight, "lexical") + share(weight, "semantic")
    out = a.join(b, "source_id", "full_outer").select("source_id", F.coalesce("exact", F.lit(False)).alias("exact"), score.alias("score"))
    return out.orderBy(F.desc("exact"), F.desc("score"), "source_id").limit(limit)


def positions(hits: DataFrame, score: str = "score") -> DataFrame:
    """Ranks from 1 of a list that is already cut to a limit."""
    return hits.withColumn("position", F.row_number().over(Window.orderBy(F.desc(score), "source_id")).cast("long"))


def merge_snippets(first: Column, second: Column, most: int = 3) -> Column:
    return F.slice(F.concat(first, F.filter(second, lambda s: ~F.array_contains(first, s))), 1, most)


def softmax_yes(yes: Column, no: Column) -> Column:
    m = F.greatest(yes, no)
    return F.exp(yes - m) / (F.exp(yes - m) + F.exp(no - m))
