"""Operator 8, benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items are partitioned by the size of their set of word shingles, in classes that double. A partition has one signature
length: its items' m smallest hashes (bottom-m MinHash), with m such that a document that holds `threshold` of any item of
the class must hold one of them: the largest size - ceil(threshold * size) + 1 in the class. A long document is probed
against the partitions one after the other, each a table of its own, so a short item inside it is found whatever the
document's length, and no match is missed. Each candidate pair is verified with the exact share of the item's shingles
that the document holds. Items with fewer words than a shingle are partitions by themselves, by their number of words.

Words are runs of bytes other than white space, lower-cased in A-Z. The signatures of one group of items go to all tasks;
a group has at most `group_items` items and `group_chars` characters, and more items make more groups, each its own pass.

Defined cases: an item with fewer words than a shingle has one shingle, all its words, and is sought as such; an item or
a document without words matches nothing, null texts are without words; repeated rows give a row each; rows with a null id
are treated alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, filter_rows, in_blocks

WIDTH, THRESHOLD = 5, 0.8
GROUP_ITEMS, GROUP_CHARS = 20_000, 20_000_000
_RESULT = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class Items:
    """Signatures of a group of items by partition, and the items' whole sets."""

    def __init__(self, ids: list[int | None], texts: list[str | None], width: int, threshold: float):
        self.ids, self.width, self.threshold = ids, width, threshold
        words = Words(texts)
        hashes, number = words.shingles(width)
        bounds = np.concatenate(([0], np.cumsum(number)))
        self.sets = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
        #: Of each item, how many words its shingles have.
        self.widths = np.minimum(words.counts, width)
        sizes = np.array([len(x) for x in self.sets], np.int64)
        need = -(-int(round(threshold * 1_000_000)) * sizes // 1_000_000)
        spare = sizes - need + 1
        #: Per (words of a shingle, size class): the signatures, where each one's items begin, the items, and a filter.
        self.partitions = {}
        classes = np.frexp(np.maximum(sizes, 1).astype(float))[1] - 1
        for w, c in sorted(set(zip(self.widths[sizes > 0].tolist(), classes[sizes > 0].tolist()))):
            own = np.flatnonzero((self.widths == w) & (classes == c) & (sizes > 0))
            m = int(spare[own].max())
            keys = np.concatenate([self.sets[i][:m] for i in own])
            owners = np.repeat(own, np.minimum(sizes[own], m))
            order = np.argsort(keys, kind="stable")
            names, first = np.unique(keys[order], return_index=True)
            table = np.zeros(1 << 20, bool)
            table[names >> U64(44)] = True
            self.partitions[w, c] = (names, np.append(first, len(keys)), owners[order], table)

    def find(self, texts: list[str | None]):
        """(text's index, item's index, shared shingles) of each pair that holds."""
        words, before = Words(texts), None
        for (w, _), (names, first, owners, table) in self.partitions.items():
            if w != before:
                before = w
                hashes, number = words.shingles(w)
                if w < self.width:  # only runs of exactly so many words
                    hashes, number = _exact_runs(words, hashes, number, w)
            bounds = np.concatenate(([0], np.cumsum(number)))
            at = np.flatnonzero(table[hashes >> U64(44)])
            place = np.searchsorted(names, hashes[at])
            place[place == len(names)] = 0
            hit = names[place] == hashes[at]
            at, place = at[hit], place[hit]
            text = np.searchsorted(bounds, at, "right") - 1
            counts = first[place + 1] - first[place]
            item = owners[np.repeat(first[place], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            pairs = np.unique(np.repeat(text, counts).astype(U64) * U64(1 << 32) + item.astype(U64))
            last, own = -1, None
            for p in pairs.tolist():
                t, i = p >> 32, p & 0xFFFFFFFF
                if t != last:
                    last, own = t, np.unique(hashes[bounds[t] : bounds[t + 1]])
                shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if shared * 1_000_000 >= round(self.threshold * 1_000_000) * len(self.sets[i]):
                    yield t, i, shared


def _exact_runs(words: Words, hashes: np.ndarray, number: np.ndarray, width: int):
    """Without the single run of a text that is shorter than `width` words."""
    short = words.counts < width
    return hashes[~np.repeat(short, number)], np.where(short, 0, number)


def item_groups(items: DataFrame, group_items: int, group_chars: int):
    """Lists of (id, text) within the bounds, read one after the other."""
    group, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = len(r["text"] or "")
        if group and (len(group) >= group_items or size + n > group_chars):
            yield group
            group, size = [], 0
        group.append((r["item_id"], r["text"]))
        size += n
    if group:
        yield group


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, group_items: int = GROUP_ITEMS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row for each document and item of which it holds at least `threshold`."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], _RESULT)
    for group in item_groups(items, group_items, group_chars):
        own = spark.sparkContext.broadcast(Items([i for i, _ in group], [t for _, t in group], width, threshold))

        def run(batches, own=own):
            x = own.value
            for ids, texts in in_blocks(batches, 4_000_000, 2):
                found = list(x.find(texts))
                if found:
                    sizes = [len(x.sets[i]) for _, i, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[t] for t, _, _ in found], pa.int64()), pa.array([x.ids[i] for _, i, _ in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array([s for _, _, s in found], pa.int64()), pa.array([s / n for (_, _, s), n in zip(found, sizes)])], [c.split()[0] for c in _RESULT.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, _RESULT))
    return out


def remove(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, group_items: int = GROUP_ITEMS, group_chars: int = GROUP_CHARS) -> DataFrame:
    """docs without the rows that hold at least `threshold` of some item; columns as they were."""
    spark = docs.sparkSession
    for group in item_groups(items, group_items, group_chars):
        own = spark.sparkContext.broadcast(Items([i for i, _ in group], [t for _, t in group], width, threshold))

        def judge(texts, own=own):
            found = {t for t, _, _ in own.value.find(texts)}
            return [i not in found for i in range(len(texts))]

        docs = filter_rows(docs, "text", judge)
    return docs


ORACLE = """
with w as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents),
v as (
  select row_number() over () as q, item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from benchmark),
widths as (select distinct least(len(words), 5) as n from v where len(words) > 0),
d as (select distinct r, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: words[i:i + n - 1])) as s from w, widths where len(words) >= n),
i as (
  select distinct q, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: words[i:i + n - 1])) as s
  from (select q, words, least(len(words), 5) as n from v where len(words) > 0)),
n as (select q, count(*) as n_item_shingles from i group by q),
p as (select r, q, count(*) as n_shared from d join i using (n, s) group by r, q)
select doc_id, item_id, n_item_shingles, n_shared, n_shared::double / n_item_shingles as containment
from p join n using (q) join w using (r) join v using (q) where n_shared * 10 >= n_item_shingles * 8
"""
