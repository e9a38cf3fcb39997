"""Embeddings: the interface for models, and a default that needs none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 256
_WORD = re.compile(r"[^\W_]+").findall


def embed_texts(texts: list[str]) -> list[list[float]]:
    """Hashed bags of words, of unit length; the default embedder."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, t in enumerate(texts):
        for w in _WORD((t or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out.tolist()


def embed_column(text: Column, embed: Callable[[list[str]], list] | None = None) -> Column:
    """Vectors of a column of texts, a batch at a time, as `embed`, which takes and returns lists, gives them: at length 1 whole numbers would be rounded, and equal cosines differ."""
    model = embed or embed_texts

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        m = np.asarray(model(texts.fillna("").tolist()), np.float64).reshape(len(texts), -1)
        return pd.Series(list(m.astype(np.float32)))

    return run(text)
