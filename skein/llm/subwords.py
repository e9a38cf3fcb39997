"""Hashed byte n-grams of words, and bounded samples of labelled rows; the classifiers share them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import _SPACE, cut

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


class Buffer:
    """Texts side by side as bytes, all white space as blanks, with a blank before, between and after."""

    def __init__(self, texts: list[str], lower=str.lower):
        raw = [lower(t).encode() for t in texts]
        joined = np.frombuffer(b" " + b" ".join(raw) + b"      ", np.uint8)
        self.space = _SPACE[joined]
        self.bytes = np.where(self.space, np.uint8(32), joined)
        edge = np.flatnonzero(np.diff(self.space.view(np.int8)))
        self.starts, self.ends = edge[::2] + 1, edge[1::2] + 1
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.begins = np.concatenate(([1], 1 + np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.begins)  # of each text, its first word
        self.counts = np.diff(self.first)

    def ngrams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """At each byte: the bucket of the n bytes from there, and whether they lie in one word with a blank at most at either end."""
        size = len(self.bytes) - 6
        h = np.zeros(size, np.uint32)
        for k in range(n):
            h += (self.bytes[k : size + k].astype(np.uint32) + np.uint32(1)) * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        h = (h * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - bits)
        if n == 1:
            return h, ~self.space[:size]
        inside = ~(self.space[:size] & self.space[1 : size + 1])
        for k in range(1, n - 1):
            inside &= ~self.space[k : size + k]
        if n == 2:
            inside &= ~(self.space[:size] | self.space[1 : size + 1]) | (self.space[:size] ^ self.space[1 : size + 1])
        return h, inside

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of values at bytes over each word and the blank before it."""
        if not len(self.starts):
            return np.zeros(0, values.dtype)
        return np.add.reduceat(values, self.starts - 1)


def fetch_texts(rows: DataFrame, keys: list[str], most: int, chars: int, seed: int) -> list[tuple]:
    """(*keys, text) in the order of a hash of the id: for each value of the first key at most `most` rows and `chars` characters.

    rows(*keys, text) are distinct in their keys, of which the last is the id, and are bounded by whoever chose them. The
    driver first gets their lengths only, and then the texts that are within the bounds.
    """
    rows = cut(rows.select(*keys, "text"), "sample")
    sizes = rows.select(*keys, F.length("text").alias("n"), F.xxhash64(keys[-1], F.lit(seed)).alias("h")).collect()
    used: dict = {}
    chosen = []
    for r in sorted(sizes, key=lambda r: (r["h"], r[keys[-1]])):
        got = used.setdefault(r[0], [0, 0])
        if got[0] < most and got[1] + r["n"] <= chars:
            got[0] += 1
            got[1] += r["n"]
            chosen.append(tuple(r[k] for k in keys))
    if not chosen:
        return []
    kinds = [rows.schema[k] for k in keys]
    wanted = rows.sparkSession.createDataFrame(chosen, StructType(kinds))
    texts = {tuple(r[k] for k in keys): r["text"] for r in rows.join(F.broadcast(wanted), keys).toLocalIterator()}
    return [(*k, texts[k]) for k in chosen]


def one_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of keys; of several texts the one with the smallest hash."""
    best = df.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_t"))
    return best.select(*keys, "_t.text")


def labelled(docs: DataFrame, labels: DataFrame, column: str, usable, rows: int, chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels 0/1 of at most `rows` rows and `chars` characters, half of either for each label.

    The sample is chosen by a hash of the id among the labels' rows that are `usable`; only its ids, at most `rows`, are
    broadcast to the documents. Rows without a text or a label 0/1 are left out, and texts of over a twentieth of `chars`;
    rows that share an id count once.
    """
    known = labels.filter(usable & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(column).alias("_y"), F.max(column).alias("_z")).filter("_y = _z").drop("_z")
    key = F.xxhash64("doc_id", F.lit(7))
    few = known.filter("_y = 0").orderBy(key).limit(rows // 2).unionByName(known.filter("_y = 1").orderBy(key).limit(rows // 2))
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").filter(F.length("text").between(1, max(1, chars // 20)))
    kept = fetch_texts(one_text(got, ["_y", "doc_id"]), ["_y", "doc_id"], rows // 2, chars // 2, 7)
    return [text for _, _, text in kept], np.array([y for y, _, _ in kept], np.int64)


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on x, by Newton's method with a little ridge."""
    if len(set(y.tolist())) < 2:
        return 0.0, 4.0 * (float(y.mean()) - 0.5) if len(y) else 0.0
    scale = float(np.std(x)) or 1.0
    z = np.stack([(x - x.mean()) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / scale, w[1] - w[0] * float(x.mean()) / scale
