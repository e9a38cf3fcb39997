"""What several operators of this subpackage share: work tables, hashed words, labelled samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
# Fixed value: the white space that \\s stands for in the tokenizers' patterns.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Send texts to Python some hundred rows at a time: whole texts are long, and each batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_made: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for a work table in the shared folder named by spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skein-")  # a single machine
    _made.append(f"{base.rstrip('/')}/skein-{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def work_tables(spark: SparkSession, keep: str | None = None):
    """Within it, work tables are temporary: at the end all that were made go, but for those that the list it gives names."""
    first, kept = len(_made), [keep]
    yield kept
    for path in _made[first:]:
        if path not in kept:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[first:] = [p for p in kept if p]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a work table and read it back: the lineage ends at files that every executor sees."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filter_rows(df: DataFrame, column: str, judge) -> DataFrame:
    """The rows of df for which judge(list of the column's values) says True, some at a time; columns as they were."""

    def run(batches):
        for part in slices(batches):
            for own in by_size(part, column):
                yield own.filter(pa.array(judge(own.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def id_remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, mod modulus. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# --- hashed words ---------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15 | 1)
_PINV = U64(pow(int(_P), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PIECE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i <= n."""
    size = max(_PIECE, 1 << int(n).bit_length()) + 1
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def scan_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes other than \\x20 and \\x09-\\x0D."""
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):  # pieces of about a megabyte, so that the 8-byte sums stay small
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[buf[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return starts, ends, mix(out)


class Words:
    """The words of several texts, lower-cased in A-Z: hashes, and per text the first word's index."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().lower() for t in texts]
        self.data = b"\n".join(raw)
        self.starts, self.ends, self.hashes = scan_words(self.data)
        sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.begins)
        self.counts = np.diff(self.first)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text, the hashes of all runs of `width` words, or of the whole sequence if it is shorter; and their number."""
        h, n = self.hashes, len(self.hashes)
        number = np.where(self.counts >= width, self.counts - width + 1, np.minimum(self.counts, 1))
        owner = np.repeat(np.arange(len(self.counts)), number)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + self.first[:-1][owner]
        span = np.minimum(self.counts[owner], width)
        out = np.zeros(len(owner), U64)
        for k in range(width):
            live = k < span
            out = np.where(live, mix(out * U64(0x9FB21C651E98DF25) + h[np.minimum(at + k, max(n - 1, 0))]), out) if n else out
        return out, number


def tidy() -> None:
    """Give freed memory back: a worker waits for its next task with what it has, beside the workers that are busy."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 400):
    """Batches of at most so many rows: fewer texts are Python strings at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    tidy()


def by_size(part: pa.RecordBatch, column: str, size: int = 1_000_000):
    """A batch in parts of about `size` bytes of text at most; one text is not cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    number = np.maximum(ends - 1, 0) // size
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), part.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield part.slice(a, b - a)


def in_blocks(batches, size: int, columns: int):
    """Group rows of Arrow batches (the second column is the text) into lists of about `size` characters."""
    rows: list[list] = [[] for _ in range(columns)]
    total = 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for to, v in zip(rows, row):
                to.append(v)
            total += len(row[1] or "") + 16
            if total >= size:
                yield rows
                rows, total = [[] for _ in range(columns)], 0
    if rows[0]:
        yield rows


def planes(x: np.ndarray, width: int | None = None) -> bytes:
    """The values' bytes, all lowest ones first: small numbers then compress well. `width` bytes of each are kept."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplanes(data: bytes, dtype, width: int | None = None) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    width = width or size
    n = len(data) // width
    out = np.zeros((n, size), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit values as planes of their differences."""
    return planes(np.diff(x, prepend=U64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, U64), dtype=U64)


# --- counters of hashes -----------------------------------------------------------------------------------------------

COUNTERS, CHUNKS = 20, 64  # bits of a counter's number, pieces in which the counters are summed


def counter(hashes: np.ndarray) -> np.ndarray:
    """The counter of a hash."""
    return (hashes & U64((1 << COUNTERS) - 1)).astype(np.int64)


class Tally:
    """A task's counters: how much was counted for hashes of each."""

    SCHEMA = "piece int, at binary, count binary"

    def __init__(self):
        self.totals = np.zeros(1 << COUNTERS, np.int64)

    def add(self, at: np.ndarray, weights: np.ndarray | None = None) -> None:
        self.totals += np.bincount(at, weights=weights, minlength=len(self.totals)).astype(np.int64)

    def rows(self):
        size = len(self.totals) // CHUNKS
        for k in range(CHUNKS):
            own = self.totals[k * size : (k + 1) * size]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([planes(np.diff(at, prepend=0).astype(np.int32))]), pa.array([planes(own[at])])], ["piece", "at", "count"])


def _sum_pieces(batches):
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for k, at, count in zip(*(c.to_pylist() for c in b.columns)):
            own = totals.setdefault(k, np.zeros((1 << COUNTERS) // CHUNKS, np.int64))
            own[np.cumsum(unplanes(at, np.int32))] += unplanes(count, np.int64)
    for k, own in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()])], ["piece", "totals"])


def sum_tallies(tallies: DataFrame, times: float = 1.0) -> np.ndarray:
    """Which counters stand out over all tasks: above 5 robust deviations over the median, and `times` the median. The driver gets 2**COUNTERS sums."""
    totals = np.zeros((CHUNKS, (1 << COUNTERS) // CHUNKS), np.int64)
    for r in tallies.repartition(CHUNKS, "piece").mapInArrow(_sum_pieces, "piece int, totals binary").toLocalIterator():
        totals[r["piece"]] = np.frombuffer(r["totals"], np.int64)
    middle = np.median(totals)
    spread = max(1.4826 * np.median(np.abs(totals - middle)), middle**0.5, 1.0)
    return totals.reshape(-1) > max(middle + 5 * spread, times * middle)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
