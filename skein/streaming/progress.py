"""How far streams are: phase, events found and done, as a listener of the session's queries learns them."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, replace

from pyspark.sql.streaming.listener import StreamingQueryListener

# The phases.
STARTING, INDEXING, IDLE, FINISHED, FAILED = "starting", "indexing", "idle", "finished", "failed"


@dataclass(frozen=True)
class State:
    phase: str = STARTING
    found: int = 0  # events that batches have begun with
    done: int = 0  # of them, those whose batch is complete
    batches: int = 0
    waiting: int = 0  # events that the source knows of and that no batch has taken, where it can tell

    @property
    def fraction(self) -> float:
        """Of what is known to be there, the share that is done; 1 where nothing is."""
        known = self.found + self.waiting
        return self.done / known if known else 1.0


class Progress(StreamingQueryListener):
    """Attach with spark.streams.addListener; `state(query.id)` is the newest known."""

    def __init__(self):
        self._states: dict[str, State] = {}
        self._seen: dict[str, int] = {}
        self._changed = threading.Condition()

    def _set(self, key: str, **changes) -> None:
        with self._changed:
            self._states[key] = replace(self._states.get(key, State()), **changes)
            self._changed.notify_all()

    def onQueryStarted(self, event) -> None:
        self._set(str(event.id), phase=STARTING)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        key, old = str(p.id), self.state(p.id)
        if self._seen.get(key, -1) >= p.batchId:  # told of again
            return
        self._seen[key] = p.batchId
        rows = sum(s.numInputRows for s in p.sources)
        behind = sum(int(s.metrics.get("numFilesOutstanding", 0)) for s in p.sources if s.metrics)
        self._set(key, phase=INDEXING if rows else IDLE, found=old.found + rows, done=old.done + rows, batches=old.batches + (rows > 0), waiting=behind)

    def onQueryIdle(self, event) -> None:
        self._set(str(event.id), phase=IDLE)

    def onQueryTerminated(self, event) -> None:
        self._set(str(event.id), phase=FAILED if event.exception else FINISHED)

    def state(self, query_id) -> State:
        return self._states.get(str(query_id), State())

    def wait(self, query_id, seconds: float = 20.0) -> State:
        """The state once a query has ended: events come a little later than what they tell of."""
        end = time.monotonic() + seconds
        with self._changed:
            while self.state(query_id).phase not in (FINISHED, FAILED) and time.monotonic() < end:
                self._changed.wait(0.2)
        return self.state(query_id)
