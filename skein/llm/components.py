"""Connected components of a table of links, by smallest labels; nothing is collected.

Tasks first replace the links they hold by a spanning forest. If what is left of all of them is within `BOUND` links, one
task joins them; beyond that, rounds of smallest labels and pointer jumping do, each written to a work table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BOUND = 500_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[label]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _forest(whole: bool, size: int = 500_000):
    """Per task, links as (node, smallest node of its tree), some links at a time; with `whole`, all of them together and roots too."""

    def run(batches):
        def close():
            nodes, roots = smallest(*(np.concatenate(p) for p in parts))
            keep = slice(None) if whole else nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])

        parts, n = ([], []), 0
        for b in batches:
            for to, column in zip(parts, b.columns):
                to.append(column.to_numpy())
            n += b.num_rows
            if not whole and n > size:
                yield close()
                parts, n = ([], []), 0
        if n:
            yield close()

    return run


def components(links: DataFrame, bound: int = BOUND, most_rounds: int = 60) -> DataFrame:
    """links(a, b) -> node, label: the smallest node that is reachable. Nodes without links are not in it."""
    forest = cut(links.select("a", "b").mapInArrow(_forest(False), "a long, b long"), "forest")
    if forest.count() <= bound:
        return forest.coalesce(1).mapInArrow(_forest(True), "a long, b long").toDF("node", "label")
    return _by_rounds(forest, most_rounds)


def _by_rounds(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Each round a node takes the smallest label around it, then the label of its label; chains halve in length."""
    both = links.filter("a <> b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.distinct(), "links")
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before = labels.agg(total).first()[0]
    for _ in range(most_rounds):
        around = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("around"))
        near = labels.join(around, labels.node == around.a).select("node", F.least("label", "around").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = cut(near.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        now = labels.agg(total).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError("the components did not settle")
