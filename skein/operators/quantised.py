"""A stored nearest-neighbour index: two levels of centres, product codes scanned in place of vectors, exact reranking.

Vectors (at length 1) go to the nearest of the coarse centres, then to the nearest of its fine ones; what is left of a vector
beside its fine centre is coded by a byte for each `STEP` dimensions, the number of the nearest of 256 book entries. Codes lie
in a folder for each coarse centre, packed: a row holds the codes of up to `BLOCK` vectors of one fine cell, without keys.
Vectors lie in a second table in the same order, with the number of their block and their place in it.

A search reads the codes of the folders nearest the query (`share` of them), adds up table entries for each vector, keeps the
best candidates, reads those vectors by block and place, and ranks them by their exact cosine. With `share` 1 and as many
candidates as vectors, or through `exact`, the answer is the exact one. Centres and books are learnt from at most `SAMPLE`
vectors, chosen by a hash of the key; every vector is indexed. Vectors of other lengths than the sample's are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectors as V

SAMPLE, ROUNDS, STEP, ENTRIES, BLOCK = 40_000, 8, 4, 256, 1024
COARSE, PER_COARSE, FINE, PER_FINE = 256, 40, 64, 50  # most coarse centres, vectors for each; most fine ones, vectors for each
SHARE, FOLDERS, PART, MOST = 0.6, 64, 100, 20_000  # of the folders, so many at least; of the vectors one in so many is reranked; at most


def unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-30)


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (2 * (m @ centres.T) - (centres * centres).sum(1)).argmax(1)


def k_means(m: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of m's rows; as many rows as centres are centres themselves."""
    c = m[rng.choice(len(m), min(k, len(m)), replace=False)]
    for _ in range(rounds if len(m) > k else 0):
        own = _nearest(m, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, weights=m[:, d], minlength=len(c)) for d in range(m.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres; fine ones by coarse one (fine, and the number of the first of each coarse one); the books."""

    coarse: np.ndarray
    fine: np.ndarray
    first: np.ndarray
    books: np.ndarray  # part, entry, dimension

    @classmethod
    def train(cls, sample: np.ndarray, number: int, seed: int = 3) -> Quantiser:
        """From a sample of `number` vectors."""
        m, rng = unit(sample), np.random.default_rng(seed)
        coarse = k_means(m, max(1, min(COARSE, number // PER_COARSE)), rng)
        own = _nearest(m, coarse)
        each = max(1, min(FINE, number // (PER_FINE * len(coarse))))
        fine = [k_means(m[own == i], each, rng) if (own == i).any() else coarse[i : i + 1] for i in range(len(coarse))]
        first = np.cumsum([0, *map(len, fine)])
        out = cls(coarse, np.concatenate(fine), first, np.zeros((0, 0, 0), np.float32))
        left = m - out.fine[out.cells(m)]
        width = STEP * -(-m.shape[1] // STEP)
        left = np.pad(left, ((0, 0), (0, width - m.shape[1])))
        books = [k_means(left[:, d : d + STEP], ENTRIES, rng) for d in range(0, width, STEP)]
        full = [np.concatenate([b, np.repeat(b[:1], ENTRIES - len(b), 0)]) for b in books]
        return cls(out.coarse, out.fine, out.first, np.stack(full).astype(np.float32))

    def cells(self, m: np.ndarray) -> np.ndarray:
        """The fine cell of each row of m, which are of length 1."""
        own, out = _nearest(m, self.coarse), np.zeros(len(m), np.int64)
        for i in np.unique(own):
            at = own == i
            out[at] = self.first[i] + _nearest(m[at], self.fine[self.first[i] : self.first[i + 1]])
        return out

    def codes(self, m: np.ndarray, cells: np.ndarray) -> np.ndarray:
        left = m - self.fine[cells]
        left = np.pad(left, ((0, 0), (0, STEP * len(self.books) - left.shape[1])))
        return np.stack([_nearest(left[:, STEP * k : STEP * (k + 1)], b) for k, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, query) -> tuple[np.ndarray, np.ndarray]:
        """The products of a query with each fine centre and each book entry."""
        q = unit(np.asarray(query))
        padded = np.pad(q, (0, STEP * len(self.books) - len(q))).reshape(len(self.books), STEP)
        return self.fine @ q, np.einsum("pes,ps->pe", self.books, padded)

    def folders(self, base: np.ndarray, share: float) -> list[int]:
        """The coarse centres whose best fine one is nearest, as many as the share of all says."""
        best = np.maximum.reduceat(base, self.first[:-1])
        return np.argsort(-best, kind="stable")[: max(min(FOLDERS, len(best)), int(np.ceil(share * len(best))))].tolist()

    def packed(self) -> tuple:
        arrays = (self.coarse, self.fine, self.first.astype(np.int64), self.books)
        return tuple(bytearray(np.ascontiguousarray(a).tobytes()) for a in arrays) + (self.coarse.shape[1],)

    @classmethod
    def unpacked(cls, coarse, fine, first, books, width: int) -> Quantiser:
        read = lambda b: np.frombuffer(bytes(b), np.float32)
        return cls(read(coarse).reshape(-1, width), read(fine).reshape(-1, width), np.frombuffer(bytes(first), np.int64), read(books).reshape(-1, ENTRIES, STEP))


_MODEL = "coarse binary, fine binary, first binary, books binary, width int, number long"


def write(vectors: DataFrame, path: str, key: str = "key", sample: int = SAMPLE) -> int:
    """Index vectors(key, embedding, ...), each row and column of them, below a new path; how many there are."""
    spark = vectors.sparkSession
    whole = vectors.filter(F.col("embedding").isNotNull())
    number = whole.count()
    if not number:
        spark.createDataFrame([(bytearray(), bytearray(), bytearray(), bytearray(), 0, 0)], _MODEL).write.parquet(f"{path}/model")
        return 0
    # the smallest hashes among one in so many rows: a scan and a bounded sort
    rate = max(1, number // (2 * sample))
    some = whole.filter(F.pmod(F.xxhash64(key), F.lit(rate)) == 0).orderBy(F.xxhash64(key, F.lit(1)), key).limit(sample).select("embedding").toPandas()
    if some["embedding"].map(len).nunique() > 1:
        raise ValueError(f"vectors of {len(some['embedding'][0])} components are indexed here, and no others")
    q = Quantiser.train(np.stack(some["embedding"].to_numpy()), number)
    names = whole.columns
    width, centres = q.coarse.shape[1], q.first
    place = pa.schema({"coarse": pa.int32(), "cell": pa.int32(), "code": pa.binary()})

    def assign(batches):
        for b in batches:
            rows = b.column(names.index("embedding"))
            if (np.diff(rows.offsets.to_numpy()) != width).any():
                raise ValueError(f"vectors of {width} components are indexed here, and no others")
            m = unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            cells = q.cells(m)
            own = [pa.array(np.searchsorted(centres, cells, "right") - 1, pa.int32()), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in q.codes(m, cells)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, *place.names])

    def number_blocks(batches):
        """Rows come by cell: a block ends with its cell, or when it is full. A partition numbers its own blocks."""
        block, n, cell = TaskContext.get().partitionId() << 40, BLOCK, None
        for b in batches:
            cells = b.column(b.schema.get_field_index("cell")).to_numpy()
            blocks, places = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int32)
            for i, c in enumerate(cells.tolist()):
                if c != cell or n == BLOCK:
                    block, n, cell = block + 1, 0, c
                blocks[i], places[i], n = block, n, n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks), pa.array(places)], [*b.schema.names, "block", "place"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in whole.dtypes)
    celled = whole.mapInArrow(assign, f"{kinds}, coarse int, cell int, code binary")
    order = ["coarse", "cell", key]
    dealt = celled.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(number_blocks, f"{kinds}, coarse int, cell int, code binary, block long, place int")
    rows.write.partitionBy("coarse").option("parquet.page.row.count.limit", 256).parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors").select("coarse", "cell", "block", "place", "code")
    grouped = stored.groupBy("coarse", "cell", "block").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))  # BLOCK rows at most
    codes = grouped.select("coarse", "cell", "block", F.transform("rows", lambda r: r["code"]).alias("codes"))

    def pack(batches):
        for b in batches:
            joined = pa.array([b"".join(c) for c in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], joined], ["coarse", "cell", "block", "codes"])

    packed = codes.mapInArrow(pack, "coarse int, cell int, block long, codes binary")
    packed.repartitionByRange("coarse", "cell", "block").sortWithinPartitions("coarse", "cell", "block").write.partitionBy("coarse").parquet(f"{path}/codes")
    spark.createDataFrame([(*q.packed(), number)], _MODEL).coalesce(1).write.parquet(f"{path}/model")
    return number


class Index:
    """A stored index of vectors."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        *model, self.number = spark.read.schema(_MODEL).parquet(f"{path}/model").first()
        self.quantiser = Quantiser.unpacked(*model) if self.number else None
        if self.number:  # folders are listed once
            self._codes = spark.read.schema("cell int, block long, codes binary, coarse int").parquet(f"{path}/codes")
            self._rows = spark.read.parquet(f"{path}/vectors")

    def vectors(self) -> DataFrame:
        return self._rows.drop("coarse", "cell", "code", "block", "place")

    def candidates(self, query, most: int, share: float = SHARE) -> DataFrame:
        """coarse, block, place, about of the `most` vectors that the codes put nearest; a task keeps no more than so many."""
        base, tables = self.quantiser.tables(query)
        near = self.quantiser.folders(base, share)
        parts = len(tables)

        def scan(batches):
            best = (np.zeros(0, np.float32), np.zeros((0, 3), np.int64))
            for b in batches:
                for coarse, cell, block, codes in zip(*(c.to_pylist() for c in b.columns)):
                    c = np.frombuffer(codes, np.uint8).reshape(-1, parts)
                    about = base[cell] + tables[np.arange(parts), c].sum(1)
                    if len(best[0]) >= most:  # what is not among the best so far goes at once
                        keep = np.flatnonzero(about > best[0][-1])
                    else:
                        keep = np.arange(len(about))
                    if len(keep):
                        scores = np.concatenate([best[0], about[keep]])
                        where = np.concatenate([best[1], np.stack([np.full(len(keep), coarse), np.full(len(keep), block), keep], 1)])
                        order = np.lexsort((where[:, 2], where[:, 1], -scores))[:most]
                        best = scores[order], where[order]
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([*(pa.array(best[1][:, k], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32()))), pa.array(best[0])], ["coarse", "block", "place", "about"])

        found = self._codes.filter(F.col("coarse").isin(near)).select("coarse", "cell", "block", "codes").mapInArrow(scan, "coarse int, block long, place int, about float")
        return found.orderBy(F.desc("about"), "block", "place").limit(most)

    def search(self, query, k: int, share: float = SHARE, most: int | None = None, exact: bool = False, alive=None, ties: tuple[str, ...] = ()) -> DataFrame:
        """The vectors' own columns and score of the k most similar rows; ties by some columns, then by the first.

        alive(rows): leaves out rows that are gone; if too few candidates are left then, four times as many are looked at."""
        alive = alive or (lambda rows: rows)
        if not self.number:
            return alive(self.vectors_of_nothing()).limit(0)
        key = self.vectors().columns[0]
        rank = lambda rows: rows.withColumn("score", V.cosine_to(list(query))("embedding")).orderBy(F.desc("score"), *ties, key).limit(k)
        most = most or max(k + 200, min(self.number // PART, MOST))
        while not exact and most < self.number:
            rows = self.fetched(self.candidates(query, most, share))
            left = alive(rows)
            if left is rows or left.count() >= k:
                return rank(left)
            most *= 4
        return rank(alive(self.vectors()))

    def vectors_of_nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], "key long, embedding array<float>, score double")

    def fetched(self, candidates: DataFrame) -> DataFrame:
        """The candidates' vectors: their folders and blocks, at most as many as there are candidates, go into the scan."""
        found = candidates.select("coarse", "block", "place").collect()
        blocks = sorted({r["block"] for r in found})
        runs: list[list[int]] = []  # of blocks that follow one another
        for b in blocks:
            if runs and b == runs[-1][1] + 1:
                runs[-1][1] = b
            else:
                runs.append([b, b])
        wanted = F.expr(" or ".join(f"block between {a} and {b}" for a, b in runs) or "false")
        at = self.spark.createDataFrame([(r["block"], r["place"]) for r in found], "block long, place int")
        rows = self._rows.filter(F.col("coarse").isin(sorted({r["coarse"] for r in found})) & wanted).join(F.broadcast(at), ["block", "place"], "left_semi")
        return rows.drop("coarse", "cell", "code", "block", "place")

