"""Operator 6, document fingerprints by winnowing.

Every run of K bytes of a text (lower-cased in A-Z) is hashed with a rolling hash; from each window of W successive hashes
the smallest is kept, the rightmost of equal ones, with its position. Any match of at least W + K - 1 = 15 bytes between two
texts lies over a common window and so shares a kept hash. A text of fewer than W runs has one window, one of fewer than K
bytes has one run. Two fingerprints' likeness is the Jaccard similarity of their sets of hashes.

Defined cases: a null text is the empty text, whose fingerprint is empty; the likeness of two empty fingerprints is 1, of
an empty and another one 0. Rows are ordered by descending id (null ids last), rows with equal ids by a hash of the text;
repeated rows give a row each; a table of one row is its own next document; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, _BYTE, _PIECE, cut, mix, powers

K, W = 8, 8


def _kgrams(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of all runs of K bytes, in pieces of about a megabyte."""
    out = []
    for i in range(0, max(1, len(data) - K + 1), _PIECE):
        part = data[i : i + _PIECE + K - 1]
        k = min(K, len(part))
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        n = len(part) - k + 1
        out.append(mix((sums[k:] - sums[:n]) * down[:n]) >> U64(32))
    return np.concatenate(out)


def winnow(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) kept of each text, by position."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list = [None] * len(texts)
    long = np.flatnonzero(sizes >= K + W - 1)
    for i in np.flatnonzero(sizes < K + W - 1):
        if not sizes[i]:
            out[i] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        else:
            h = _kgrams(np.frombuffer(texts[i].lower(), np.uint8))
            at = len(h) - 1 - int(np.argmin(h[::-1]))
            out[i] = (h[at : at + 1].astype(np.uint32), np.array([at]))
    if len(long):
        data = np.frombuffer(b"".join([texts[i].lower() for i in long]), np.uint8)
        h = _kgrams(data)
        at = np.arange(len(h), dtype=U64)
        low = (h << U64(32)) | (U64(0xFFFFFFFF) - at)  # the smallest is the smallest hash, the rightmost of equal ones
        width = 1
        while width < W:  # windows of twice the width, the last step over what is left
            step = min(width, W - width)
            low = np.minimum(low[: len(low) - step], low[step:])
            width += step
        begin = np.cumsum(sizes[long]) - sizes[long]
        owner = np.searchsorted(begin, np.arange(len(low)), "right") - 1
        good = np.arange(len(low)) <= begin[owner] + sizes[long][owner] - (K + W - 1)
        low, owner = low[good], owner[good]
        new = np.flatnonzero((np.diff(low, prepend=low[:1] ^ U64(1)) != 0) | (np.diff(owner, prepend=-1) != 0))
        low, owner = low[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(len(long) + 1))
        hashes = (low >> U64(32)).astype(np.uint32)
        places = (U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.int64)
        for k, i in enumerate(long):
            a, b = bounds[k], bounds[k + 1]
            out[i] = (hashes[a:b], places[a:b] - begin[k])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray) -> str:
    """The kept hashes in order, eight hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, hashes, positions (of bytes)."""

    def run(batches):
        for b in batches:
            kept = winnow([(t or "").encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.astype(np.int64) for h, _ in kept], pa.list_(pa.int64())), pa.array([p for _, p in kept], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


# --- edited texts ---------------------------------------------------------------------------------------------------

_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>"
_NAMES = ", ".join(c.split()[0] for c in _RESULT.split(", "))
_DEALT = "ids array<long>, sizes array<long>, texts binary, part int, head binary, tail binary"
_SCHEMA = pa.schema({"ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "texts": pa.binary(), "part": pa.int32(), "head": pa.binary(), "tail": pa.binary()})


def _compressed(batches):
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        texts = [squeeze((t or "").encode()) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), b.column(2)], ["doc_id", "text", "tie"])


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _compare(group: list[tuple[tuple[int, str], str]]) -> list[pa.Array]:
    """The result's columns for pairs of (a document, the next one's text), each next text being the next pair's own."""
    texts = [t for (_, t), _ in group]
    changed = [edited(t, f) for (_, t), f in group]
    prints = winnow([t.encode() for t in [*texts, group[-1][1], *changed]])
    own, new = [p[0] for p in prints[: len(texts) + 1]], [p[0] for p in prints[len(texts) + 1 :]]
    places = [p[1].astype(np.int32) for p in prints]
    return [
        pa.array([d for (d, _), _ in group], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array([as_text(h) for h in own[:-1]], pa.string()), pa.array([as_text(h) for h in new], pa.string()),
        pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        _lists(places[: len(texts)]), _lists(places[len(texts) + 1 :]),
    ]


def _row(ids: list, sizes: list | None, texts: bytes | None, *ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([ids, sizes, texts, *(ends or [None] * 3)], _SCHEMA)], schema=_SCHEMA)


def _within(batches):
    """All documents of a range but its last one, in groups with the text that follows, compressed together; and one row with the range's first text and its last document."""
    part, head, held = TaskContext.get().partitionId(), None, None
    squeeze = zstandard.ZstdCompressor(level=3).compress
    ids, texts, size = [], [], 0
    for b in batches:
        for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            text = zstandard.decompress(data)
            if held is None:
                head = data
            else:
                ids.append(held[0])
                texts.append(held[1])
                size += len(held[1])
            held = (doc_id, text, data)
            if size > 1_500_000:
                yield _row(ids, [len(t) for t in [*texts, text]], squeeze(b"".join([*texts, text])))
                ids, texts, size = [], [], 0
    if ids:
        yield _row(ids, [len(t) for t in [*texts, held[1]]], squeeze(b"".join([*texts, held[1]])))
    if held:
        yield _row([held[0]], None, None, part, head, held[2])


def _answer(batches):
    for b in batches:
        for ids, sizes, packed in zip(*(b.column(c) for c in ("ids", "sizes", "texts"))):
            data = zstandard.decompress(packed.as_py())
            ends = np.cumsum([0, *sizes.as_py()]).tolist()
            texts = [data[i:j].decode() for i, j in zip(ends, ends[1:])]
            pairs = [((doc_id, t), following) for doc_id, t, following in zip(ids.as_py(), texts, texts[1:])]
            yield pa.RecordBatch.from_arrays(_compare(pairs), _NAMES.split(", "))


def _across(batches):
    for b in batches:
        for doc_id, tail, head in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tail", "head"))):
            text, following = (zstandard.decompress(x).decode() for x in (tail, head))
            yield pa.RecordBatch.from_arrays(_compare([((doc_id, text), following)]), _NAMES.split(", "))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the head of the next document by descending id.

    Texts are dealt once by ranges of the id, compressed. A range answers for all its documents but the last, whose next
    one heads the next range; those ends, two texts a range, are joined by the ranges' numbers. After the last document
    comes the first. The work table holds compressed texts: fingerprints are larger than the texts and go to the result only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    packed = rows.mapInArrow(_compressed, "doc_id long, text binary, tie long")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = packed.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut(ranged.mapInArrow(_within, _DEALT), "fingerprints")
    ends = dealt.filter(F.col("part").isNotNull())
    numbers = ends.select("part")  # one row a range
    following = numbers.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy()).alias("least"))
    following = following.select("part", F.coalesce("next", "least").alias("next"))
    tails = ends.select("part", F.element_at("ids", 1).alias("doc_id"), "tail").join(following, "part")
    heads = ends.select(F.col("part").alias("next"), "head")
    last = tails.join(heads, "next").select("doc_id", "tail", "head").mapInArrow(_across, _RESULT)
    return dealt.filter(F.col("part").isNull()).select("ids", "sizes", "texts").mapInArrow(_answer, _RESULT).unionByName(last)
