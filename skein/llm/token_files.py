"""Operator 4, token-id output: files of token ids under a static range asymmetric numeral system.

A file is a Parquet part whose rows are frames, in ascending order of the document id over all files. A frame holds the
ids of consecutive documents (about `frame_tokens`, whole documents only): one frequency table, shared by blocks of 8,192
ids that are encoded independently, 16 interleaved states a block. Its directory is the checkpoints: per block the final
states, the place of its words and a CRC-32 of its ids, so any block is decoded without the others; the frame ends with a
CRC-32 of itself. Blocks of a frame are coded side by side as numpy lanes.

Defined cases: a null or empty text holds only the end id; rows with a null id come first; rows with equal ids are ordered
by a hash of their text, and equal rows are interchangeable; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import WHITE, in_blocks, planes, unplanes, work_path

MAGIC, SCALE, LANES, BLOCK = b"SKRA0001", 18, 16, 8192
FRAME_TOKENS = 1 << 22
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sIIII")
FRAMES = "file int, frame int, n_tokens long, ids array<long>, lengths binary, data binary"


# --- the coder ------------------------------------------------------------------------------------------------------


def frequencies(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, and their shares of 2**SCALE, each at least 1."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more symbols than the table's scale can hold")
    share = np.maximum(1, counts * total // counts.sum())
    over = int(share.sum()) - total
    for i in np.argsort(-share, kind="stable"):  # what rounding left over, from the largest on
        if over <= 0:
            share[i] -= over
            break
        take = min(over, int(share[i]) - 1)
        share[i] -= take
        over -= take
    return symbols, share


def _lanes(tokens: np.ndarray, fill: int) -> np.ndarray:
    """tokens as [step, block * lane]."""
    blocks = max(1, -(-len(tokens) // BLOCK))
    padded = np.full(blocks * BLOCK, fill, np.int32)
    padded[: len(tokens)] = tokens
    return np.ascontiguousarray(padded.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, -1))


def encode_frame(tokens: np.ndarray) -> bytes:
    if not len(tokens):
        body = _HEAD.pack(MAGIC, 0, 0, 0, 0)
        return body + struct.pack("<I", zlib.crc32(body))
    symbols, share = frequencies(tokens)
    places = np.zeros(int(symbols[-1]) + 1, np.int32)
    places[symbols] = np.arange(len(symbols))
    place = places[tokens]
    grid = _lanes(place, int(np.argmax(share)))
    steps, width = grid.shape
    blocks = width // LANES
    freq, start = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    rest, shift, half = np.uint64(1 << SCALE) - freq, np.uint64(63 - SCALE), np.uint64(32)
    x = np.full(width, _LOW)
    words, sent = np.empty((steps, width), np.uint32), np.empty((steps, width), bool)
    for i in range(steps - 1, -1, -1):
        s = grid[i]
        f = freq[s]
        big = x >= f << shift
        words[i], sent[i] = x, big
        np.right_shift(x, half, out=x, where=big)
        q = x // f
        q *= rest[s]
        x += q
        x += start[s]
    by_block = lambda a: a.reshape(steps, blocks, LANES).transpose(1, 0, 2)
    stream = by_block(words)[by_block(sent)]
    sums = [zlib.crc32(tokens[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(tokens), BLOCK)]
    body = b"".join([
        _HEAD.pack(MAGIC, len(tokens), blocks, len(symbols), len(stream)),
        planes(np.diff(symbols, prepend=0).astype("<u4")), planes(share.astype("<u4")),
        by_block(sent).sum((1, 2)).astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), x.astype("<u8").tobytes(),
        stream.astype("<u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def decode_frame(data: bytes, only: slice = slice(None)) -> np.ndarray:
    """The ids of a frame, or of some of its blocks. A checksum that doesn't match is an error."""
    body = data[:-4]
    if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("the frame's checksum doesn't match")
    magic, n, blocks, kinds, n_words = _HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a frame of this format")
    if not n:
        return np.zeros(0, np.uint32)
    at = _HEAD.size

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return body[at - size : at]

    symbols = np.cumsum(unplanes(take(4 * kinds), "<u4").astype(np.int64)).astype(np.uint32)
    share = unplanes(take(4 * kinds), "<u4").astype(np.int64)
    lengths = np.frombuffer(take(4 * blocks), "<u4").astype(np.int64)
    sums = np.frombuffer(take(4 * blocks), "<u4")
    x = np.frombuffer(take(8 * blocks * LANES), "<u8").reshape(blocks, LANES)[only].reshape(-1)
    stream = np.frombuffer(take(4 * n_words), "<u4").astype(np.uint64)
    chosen = np.arange(blocks)[only]
    next_word = (np.cumsum(lengths) - lengths)[only]
    slots = np.repeat(np.arange(kinds), share)
    freq, start = share.astype(np.uint64), (np.cumsum(share) - share).astype(np.uint64)
    out = np.empty((BLOCK // LANES, len(x)), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    stream = np.append(stream, np.uint64(0))
    for i in range(BLOCK // LANES):
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[i] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        small = x < _LOW
        per = small.reshape(-1, LANES)
        order = np.cumsum(per, axis=1)
        at_word = (next_word[:, None] + order - 1)[per]
        x[small] = (x[small] << np.uint64(32)) | stream[at_word]
        next_word = next_word + order[:, -1]
    ids = symbols[out.reshape(-1, len(chosen), LANES).transpose(1, 0, 2).reshape(-1)]
    if len(chosen) and chosen[-1] == blocks - 1:
        ids = ids[: len(ids) - (blocks * BLOCK - n)]
    for k, b in enumerate(chosen):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != sums[b]:
            raise ValueError(f"the checksum of block {b} doesn't match")
    return ids


# --- the tokenizer --------------------------------------------------------------------------------------------------

# White space other than blanks and line ends, and what else Python's str methods take for white space.
_RARE = re.compile("[" + WHITE.replace(" ", "").replace("\n", "") + "\x1c-\x1f]")
_RARE_ASCII = re.compile("[\t\x0b-\r\x1c-\x1f]")
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_END, _WHOLE = "\x1f", "\x1d"  # units that stand for the end of a document and for a text that is encoded by itself


def _regular(text: str) -> bool:
    """Whether only single blanks and single line ends part the words."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not (_RARE_ASCII if text.isascii() else _RARE).search(text)


class ByteEncoder:
    """The library's encoding of texts, by units that its split never joins: a word with the white space before it.

    A unit stands for itself after a blank, unless it begins with a line end or with \\r, which marks one that stands as it
    is. Arrow splits a block of texts into units and numbers the different ones; those that came before are looked up in a
    bounded table of two generations. New ones go to the library: those that its split takes for one word and a sentence's
    end straight to its model.
    """

    KEPT = 850_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.kept = _Units(self.learn)
        self.model = self.library.model
        self.symbols = byte_symbols()
        self.blank = self.symbols[32]
        self.line_end = self.raw("\n")
        self.tails: dict[str, bytes] = {"": b""}

    def raw(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, u: str) -> bytes:
        """The ids of a unit that the newer table doesn't have."""
        if (got := self.old.get(u)) is not None:
            return got
        mark = u[0] in "\r\n"
        word = u[1:] if mark else " " + u
        core = word.rstrip(".,:;!?")
        if not core[not mark :].isalpha():
            return self.raw(word if u[0] != "\n" else u)
        if len(core) < len(word) or u[0] == "\n":  # letters and what ends a sentence: the split is plain
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self.raw(tail)
            return (self.line_end if u[0] == "\n" else b"") + self.kept["\r" + core if mark else core[1:]] + self.tails[tail]
        text = core if core.isascii() else core.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(self.blank + text[1:] if text[0] == " " else text)]).tobytes()

    def block(self, texts: list[str | None], end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, `end` after each one's, and how many each has."""
        whole: dict[str, bytes] = {_END: end}
        lines = []
        for k, t in enumerate(texts):
            if not t:
                lines.append(_END)
            elif _regular(t) and not any(s in t for s in self.specials):
                lines.append(f"\r{t.replace("\n", " \n") if "\n" in t else t} {_END}")
            else:
                name = f"{_WHOLE}{k}"
                whole[name] = self.raw(t) if any(s in t for s in self.specials) else b"".join([self.kept["\r" + u] for u in _UNITS.findall(t)])
                lines.append(f"{name} {_END}")
        parts = pc.split_pattern(pa.array(lines, pa.string()), " ")
        coded = parts.values.dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary
        units = pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), " ")[0].as_py().split(" ")  # quicker than one by one
        ids = [whole[u] if u[0] in "\x1d\x1f" else self.kept[u] for u in units]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        own = sizes[at]
        ends = np.cumsum(own)
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends + own, own)
        place += np.arange(len(place))
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy()]
        if len(self.kept) > self.KEPT:
            self.old, self.kept = self.kept, _Units(self.learn)
        return flat[place], np.diff(bounds)


class _Units(dict):
    """Units and their ids; new ones are learnt when they are asked for."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, unit: str) -> bytes:
        got = self[unit] = self.learn(unit)
        return got


@lru_cache(2)
def encoder_for(path: str) -> ByteEncoder:
    """One for all tasks of a worker, which then share its table."""
    return ByteEncoder(path)


# --- the operator ---------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame_tokens: int = FRAME_TOKENS) -> None:
    """Encode docs(doc_id, text), the end id after each, and write the files to `path` in ascending order of doc_id."""

    def run(batches):
        encoder = encoder_for(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        file, frame = TaskContext.get().partitionId(), 0
        ids, lengths, parts = [], [], []

        def close():
            tokens = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([frame], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([planes(np.concatenate(lengths).astype(np.uint32))], pa.binary()), pa.array([encode_frame(tokens)], pa.binary())], ["file", "frame", "n_tokens", "ids", "lengths", "data"])

        for own, texts in in_blocks(batches, 4_000_000, 2):
            ids += own
            tokens, sizes = encoder.block(texts, end)
            parts.append(tokens)
            lengths.append(sizes)
            if sum(map(len, parts)) >= frame_tokens:
                yield close()
                frame, ids, lengths, parts = frame + 1, [], [], []
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.select("doc_id", "text").mapInArrow(run, FRAMES).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: file, frame, place in the frame, doc_id, start, ids."""
    return _read(spark, path, "ids array<int>", lambda own: own.astype(np.int32).tolist(), pa.list_(pa.int32()))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: file, frame, place in the frame, doc_id, start, n_tokens, ids_crc32."""
    return _read(spark, path, "ids_crc32 long", lambda own: zlib.crc32(own.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, column: str, make, kind) -> DataFrame:
    frames = spark.read.schema(FRAMES).parquet(path)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lengths = unplanes(row["lengths"], np.uint32).astype(np.int64)
                ids = decode_frame(row["data"])
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                made = [make(ids[i:j]) for i, j in zip(bounds, bounds[1:])]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.int32()), pa.array([row["frame"]] * n, pa.int32()), pa.array(bounds[:-1]), pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(made, kind)], ["file", "frame", "inside", "doc_id", "n_tokens", column.split()[0]])

    docs = frames.mapInArrow(run, f"file int, frame int, inside long, doc_id long, n_tokens long, {column}")
    sizes = frames.select("file", "frame", "n_tokens")
    files = sizes.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # one row a file
    before = files.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("file_start"))
    within = sizes.select("file", "frame", (F.sum("n_tokens").over(Window.partitionBy("file").orderBy("frame")) - F.col("n_tokens")).alias("frame_start"))
    starts = within.join(before, "file").select("file", "frame", (F.col("file_start") + F.col("frame_start")).alias("base"))
    return docs.join(starts, ["file", "frame"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")


def written_checksums(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write(docs, path, tokenizer, end_id)
    return checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
