"""What a batch stream is doing, and what its last runs counted, from Spark's own events."""

from __future__ import annotations

import threading
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """For each named stream: running, started, rows (of the run so far), batch (the last one), counts (what observe() saw, summed over the run) and error.

    Register it with ``watch``. Counts come from ``df.observe(name, ...)`` within the stream, while it writes: no job is run for them."""

    def __init__(self) -> None:
        self._lock, self._names, self._known = threading.Lock(), {}, {}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        with self._lock:
            self._names[event.runId] = event.name
            self._known[event.name] = {"running": True, "started": event.timestamp, "rows": 0, "batch": None, "counts": {}, "error": None}

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            known = self._known.setdefault(p.name, {"running": True, "started": p.timestamp, "rows": 0, "batch": None, "counts": {}, "error": None})
            known["rows"] += p.numInputRows
            known["batch"] = p.batchId
            for row in (p.observedMetrics or {}).values():
                for name, n in row.asDict().items():
                    known["counts"][name] = known["counts"].get(name, 0) + (n or 0)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        with self._lock:
            known = self._known.get(self._names.pop(event.runId, None))
            if known:
                known["running"], known["error"] = False, event.exception

    def of(self, name: str = "receipt-batch") -> dict[str, Any]:
        """A copy; without a run so far, one that says so."""
        with self._lock:
            known = self._known.get(name)
            return {**known, "counts": dict(known["counts"])} if known else {"running": False, "started": None, "rows": 0, "batch": None, "counts": {}, "error": None}


def watch(spark: SparkSession) -> Progress:
    listener = Progress()
    spark.streams.addListener(listener)
    return listener
