"""Cutting texts into overlapping passages."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, OVERLAP = 384, 64
_WORDS = re.compile(r"[^ \t\n\x0b\f\r]+").findall


def chunk(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Passages of at most `target` words. Paragraphs are packed whole; only an over-long run of words is cut, with an overlap of half a passage at most."""
    overlap = max(0, min(overlap, target // 2))
    step = max(target - overlap, 1)
    out, held = [], []
    for line in unicodedata.normalize("NFC", text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        words = _WORDS(line)
        if not words:
            continue
        if held and len(held) + len(words) > target:
            out.append(held)
            held = []
        held = held + words
        n = len(held)
        if n >= target:
            m = (n - target) // step + 1
            out += [held[k * step : k * step + target] for k in range(m)]
            held = [] if (n - target) % step == 0 else held[m * step :]
    if held:
        out.append(held)
    return [" ".join(w) for w in out]


def chunk_rows(df: DataFrame, key: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, body) for each passage of df's texts, batch by batch; no shuffle."""

    def run(batches):
        for b in batches:
            keys, ordinals, bodies = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = chunk(t, target, overlap)
                keys += [k] * len(parts)
                ordinals += range(len(parts))
                bodies += parts
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(ordinals, pa.int32()), pa.array(bodies, pa.string())], [key, "ordinal", "body"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ordinal int, body string")
