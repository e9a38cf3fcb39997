"""Operator 11, hard-negative mining: exact inner products of integer vectors by bit planes, most significant first.

Vectors become integers (256 times a component, rounded down). A row's components are taken apart into bit planes in
two's complement; a plane's inner product with an anchor, times its weight, is added to the row's score, most significant
plane first. What is still unknown after the plane of weight 2**t is at least 2**t - 1 times the sum of the anchor's
negative components and at most as much of the positive ones, so each plane halves the interval that holds a score. A row
is dropped for an anchor once its interval lies outside the range of scores that is asked for, or under the k-th best score
known; what is left after the last plane has its exact score. Planes meet all rows as matrix products while many rows are
left, and only the pairs left from then on.

Two searches are made. The first finds each anchor's positives among the rows of its label, the second its negatives among
all rows, in the range that each positive sets. Rows and anchors are dealt into blocks (`rows`, `anchors`), of a label
in the first search, and each pair of blocks is a group: no task holds more than two blocks, however many rows a label has.
A group gives the k best of each anchor and range, which are merged by anchor and range.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; components whose
256-fold is beyond 2**22 are held at that, so that scores of up to 2**14 components fit a long; a missing component of a
shorter vector is 0; rows that share the anchor's id are not other rows; rows that share an id are rows of their own, repeated
rows included, as positives, negatives and anchors; an anchor without other rows of its label has no result, nor has a
positive whose range holds no row (a negative score's range is empty); an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE, BOUND, STEP = 256, 1 << 22, 100
ROWS, ANCHORS = 8_192, 8_192
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = -(1 << 62), 1 << 62
FOUND = "a long, slot int, score long, id long, k long"
_FOUND = pa.schema({"a": pa.int64(), "slot": pa.int32(), "score": pa.int64(), "id": pa.int64(), "k": pa.int64()})


class Best:
    """The k best (score, then smaller id) of each anchor's slots, and what a score must reach to be among them."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.bar = np.full((anchors, slots), LEAST, np.int64)
        self.held = np.zeros((0, 5), np.int64)  # anchor, slot, -score, id, key

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(anchor):
            return
        both = np.concatenate([self.held, np.stack([anchor, slot, -score, ids, keys], 1)])
        both = both[np.lexsort(both.T[::-1])]
        cell = both[:, 0] * self.slots + both[:, 1]
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        nth = np.arange(len(cell)) - np.repeat(begin, np.diff(np.append(begin, len(cell))))
        self.held = both[nth < self.k]
        last = self.held[nth[nth < self.k] == self.k - 1]
        self.bar[last[:, 0], last[:, 1]] = -last[:, 2]


def sliced_search(x, ids, keys, q, allowed, low, high, k: int, strip: int = 128, sparse: float = 0.125) -> np.ndarray:
    """The k best rows of x for each anchor in q and each of its ranges low..high: (anchor, slot, -score, id, key) rows.

    allowed(anchors, rows): which of the pairs of the two slices count at all."""
    n_slots = low.shape[1]
    best = Best(len(q), n_slots, k)
    if not len(x) or not len(q):
        return best.held
    bits = max(int(x.max()).bit_length(), int(~x.min()).bit_length()) + 1
    kind = np.float32 if x.shape[1] * int(np.abs(q).max(initial=0)) < 1 << 24 else np.float64  # sums stay exact
    pos, neg = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    at, size = 0, 256
    while at < len(x):  # pieces grow: the bar is known early
        rows = slice(at, at + size)
        planes = [((x[rows] >> t) & 1).astype(kind) for t in range(bits)]
        for a in range(0, len(q), strip):
            own = slice(a, a + strip)
            floor, roof = np.maximum(low[own], best.bar[own]), high[own]
            alive = allowed(own, rows) & (low[own] <= roof).any(1)[:, None]
            scores = np.zeros(alive.shape, np.int64)
            dense = q[own].astype(kind)
            t = bits
            while t and (t == bits or alive.mean() > sparse):
                t -= 1
                part = (dense @ planes[t].T).astype(np.int64)
                scores += part * (-(1 << t) if t == bits - 1 else 1 << t)
                rest = (1 << t) - 1
                alive &= scores >= (floor.min(1) - rest * pos[own])[:, None]
                alive &= scores <= (roof.max(1) - rest * neg[own])[:, None]
            i, j = np.nonzero(alive)
            s = scores[i, j]
            while True:
                rest = (1 << t) - 1
                fits = ((s + rest * pos[own][i])[:, None] >= floor[i]) & ((s + rest * neg[own][i])[:, None] <= roof[i])
                left = fits.any(1)
                i, j, s, fits = i[left], j[left], s[left], fits[left]
                if not t:
                    break
                t -= 1
                s = s + (-(1 << t) if t == bits - 1 else 1 << t) * np.einsum("nd,nd->n", planes[t][j], dense[i], dtype=np.float64).astype(np.int64)
            pair, slot = np.nonzero(fits)
            best.add(i[pair] + a, slot, s[pair], ids[rows][j[pair]], keys[rows][j[pair]])
        at, size = at + size, size * 2
    return best.held


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones continued by zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _group(k: int, same: bool):
    """Of a block of rows and a block of anchors, the k best of each anchor and slot."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _FOUND.empty_table()
        width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (rows, anchors))
        n = lambda t, c: t.column(c).to_numpy()
        x, q = _matrix(rows.column("v"), width), _matrix(anchors.column("v"), width)
        ids, keys = n(rows, "vec_id"), n(rows, "k")
        apart, mine = (ids, n(anchors, "vec_id")) if same else (n(rows, "label"), n(anchors, "label"))
        low, high = (_matrix(anchors.column(c), POSITIVES if not same else 1) for c in ("low", "high"))
        if not same:  # fewer positives than slots: ranges that nothing is in
            given = np.diff(anchors.column("low").combine_chunks().offsets.to_numpy())
            low[np.arange(POSITIVES)[None] >= given[:, None]] = MOST
        found = sliced_search(x, ids, keys, q, lambda a, r: mine[a][:, None] != apart[r][None], low, high, k)
        anchor = n(anchors, "k")[found[:, 0]]
        return pa.Table.from_arrays([pa.array(anchor), pa.array(found[:, 1].astype(np.int32)), pa.array(-found[:, 2]), pa.array(found[:, 3]), pa.array(found[:, 4])], schema=_FOUND)

    return run


def prepared(embeddings: DataFrame) -> DataFrame:
    """The rows that take part, their labels moved where the id is divisible by 7, as integer vectors with a number k each."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~odd)
    label = F.col("label").cast("long")
    held = lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))
    return whole.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(held(x)).cast("int")).alias("v"), F.monotonically_increasing_id().alias("k"),
    )


def _search(rows: DataFrame, anchors: DataFrame, by: str, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """Each block of rows with each block of anchors; `blocks` has the number of both, by the columns of `by`."""
    place = lambda number: F.pmod(F.xxhash64("k"), F.col(number)).cast("int")
    dealt = lambda number: F.explode(F.sequence(F.lit(0), F.col(number).cast("int") - 1))
    blocks, extra = blocks.filter("n_anchors > 0"), [by] if by != "label" else []
    new = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  # the two sides come from one table
    x = rows.join(blocks, by).select(*new("vec_id", "label", "v", "k", *extra), place("n_rows").alias("i"), dealt("n_anchors").alias("j"))
    q = anchors.join(blocks, by).select(*new("vec_id", "label", "v", "k", *extra), "low", "high", place("n_anchors").alias("j"), dealt("n_rows").alias("i"))
    key = [by, "i", "j"]
    found = x.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(_group(k, same), FOUND)
    order = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "id", "k")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(x: DataFrame, by: str, rows: int, anchors: int) -> DataFrame:
    """How many blocks of rows and of anchors there are, by the column `by`."""
    n = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % STEP == 0).alias("m"))
    return n.select(by, F.ceil(F.col("n") / rows).alias("n_rows"), F.ceil(F.col("m") / anchors).alias("n_anchors"))


def mine(embeddings: DataFrame, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """Each anchor's positives and their hard negatives."""
    x = cut(prepared(embeddings), "vectors").withColumn("all", F.lit(0))
    q = x.filter(F.col("vec_id") % STEP == 0)
    unbound = q.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    positives = cut(_search(x, unbound, "label", _blocks(x, "label", rows, anchors), POSITIVES, True), "positives")
    own = positives.groupBy(F.col("a").alias("k")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("own"))
    low = F.expr("transform(own, p -> (3 * p.score + pmod(-3 * p.score, 10)) div 10)")  # 30 of 100, rounded up
    high = F.expr("transform(own, p -> (9 * p.score - pmod(9 * p.score, 10)) div 10)")  # 90 of 100, rounded down
    ranged = q.join(own, "k").withColumns({"low": low, "high": high})
    found = _search(x, ranged, "all", _blocks(x, "all", rows, anchors), NEGATIVES, False)
    of = positives.select("a", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = q.select(F.col("k").alias("a"), F.col("vec_id").alias("anchor_id"))
    out = found.join(of, ["a", "slot"]).join(named, "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
with whole as (select * from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select row_number() over () as k, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(greatest(least({SCALE} * x::double, {BOUND}), -{BOUND}))::bigint) as v from whole),
scored as (select q.k as a, q.vec_id as anchor_id, r.k, r.vec_id, q.label = r.label as same,
  list_sum(list_transform(list_zip(q.v, r.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
  from r as q, r where q.vec_id % {STEP} = 0 and (q.vec_id <> r.vec_id or q.label <> r.label)),
positives as (select *, row_number() over (partition by a order by score desc, vec_id, k) as nth from scored where same qualify nth <= {POSITIVES})
select p.anchor_id, p.vec_id as positive_id,
  row_number() over (partition by p.a, p.nth order by n.score desc, n.vec_id, n.k)::int as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= {NEGATIVES}
"""
