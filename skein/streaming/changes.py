"""Incremental indexing: a stream of file changes applied to an engine's index, batch by batch.

The stream's position is the query's checkpoint, so a batch may come again after a failure; applying it is idempotent, as the
manifest keeps the number of the last batch. `newest_ever` keeps the last event of each path as state: what arrives late, in
whatever batch, never wins over a later event.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.sources.change_log import ChangeLog

SCHEMA = "path string, event_id long, kind string, ts timestamp"
LATENCY = "350 milliseconds"  # fixed value
KEEP = "7 days"  # how long a path's last event is remembered, and how late an event may come
_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Changes as they are written to a folder of JSON lines, in any store; a bounded number of files a batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def read_log(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """The events of a mounted log after the event `since`, a task a file; the position of a stream is an event's id.

    Events wait for one another as long as the query's trigger says: LATENCY is how long a watcher would hold them.
    """
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("skein_changes").option("path", folder).option("since", since).load()


def _milliseconds(interval: str) -> int:
    n, unit = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", interval).groups()
    return int(n) * _MS[unit]


def newest_ever(changes: DataFrame, keep: str = KEEP) -> DataFrame:
    """Of each path the last event by id over all batches so far, where a batch brings a newer one. State that is older than `keep` goes; so do events that come later than that."""
    kept = _milliseconds(keep)

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tops = [f.nlargest(1, "event_id") for f in frames if len(f)]
        top = pd.concat(tops).nlargest(1, "event_id")
        last = state.get[0] if state.exists else None
        if last is None or int(top["event_id"].iloc[0]) > last:
            last = int(top["event_id"].iloc[0])
            state.update((last,))
            yield top[["path", "event_id", "kind", "ts"]]
        at = top["ts"].iloc[0]
        known = int(at.timestamp() * 1000) if not pd.isna(at) else 0
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), known, 0) + kept + 1)

    grouped = changes.filter("event_id is not null").withWatermark("ts", keep).groupBy("path")
    return grouped.applyInPandasWithState(newest, SCHEMA, "event_id long", "update", GroupStateTimeout.EventTimeTimeout)


def actions_of(batch: DataFrame) -> DataFrame:
    """What to do about each path's last event: a recovery calls for a scan."""
    action = F.when(F.col("kind") == "recover", "reconcile").when(F.col("kind") == "delete", "delete").otherwise("upsert")
    return batch.select("path", "event_id", action.alias("action"))


def follow(changes: DataFrame, engine, load: Callable[[DataFrame], DataFrame], checkpoint: str, keep: str = KEEP) -> StreamingQuery:
    """Apply a stream to an engine's index: a segment a batch, not a new index. `load`(path, event_id) gives files with their texts.

    A recovery of a path above, at or below a root that the engine knows has the root scanned again; one elsewhere is a change of that path.
    """

    def each(batch: DataFrame, number: int) -> None:
        manifest = engine.log.current()
        if number <= manifest.batch:
            return
        batch = batch.persist()
        try:
            actions = actions_of(batch)
            touches = {root_id: (F.col("path") == root) | F.startswith("path", F.lit(root + "/")) | F.startswith(F.lit(root), F.concat("path", F.lit("/"))) for root_id, root in manifest.roots.items()}
            known = F.lit(False)
            if touches:
                hit = actions.filter("action = 'reconcile'").agg(*(F.max(c).alias(r) for r, c in touches.items())).first()
                for root_id, c in touches.items():
                    known = known | c
                    if hit[root_id]:
                        engine.reconcile(manifest.roots[root_id], root_id)
            changed = actions.filter((F.col("action") == "upsert") | ((F.col("action") == "reconcile") & ~known)).select("path", "event_id")
            gone = engine.files().select("source_id", "path").join(actions.filter("action = 'delete'"), "path", "left_semi") if manifest.segments else None
            engine.apply(load(changed), gone, batch=number)
        finally:
            batch.unpersist()

    return newest_ever(changes, keep).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_time(changes: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Changes of each kind by time window; later than `late` they are left out."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
