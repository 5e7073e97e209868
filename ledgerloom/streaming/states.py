"""States of documents as a stream: what each arrival changes, what is being processed, and what is stuck.

Rows are arrivals (a document's text and tag) and outcomes (done, error or skipped), keyed by document and kept in the stream's state: the hash of
the text last seen, that of the text last parsed, whether there is a receipt, the status and since when. An arrival gives the predicates of
operators.documents.changes; one that needs parsing puts the document to processing and sets a timer, an outcome clears it. When the watermark
passes the timer first, the document becomes an error (timed_out), and its next arrival is parsed again.

Texts are hashed before they are keyed, so they neither cross the shuffle nor reach Python. Rows of one document in one micro-batch are taken by
time, arrivals before outcomes; rows older than the watermark are dropped. State and timers live in the checkpoint, so a stream
that is stopped at any place and started again gives the rows that one run over all files would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerloom.functions.fixed import MIN_TEXT_CHARS
from ledgerloom.functions.text import content_hash, strip

EVENTS = "doc_id long, at timestamp, text string, tagged boolean, outcome string"
STATE = "content_hash string, parse_hash string, waiting_hash string, has_receipt boolean, status string, due long"
ROWS = "doc_id long, at timestamp, status string, error_message string, content_changed boolean, forced boolean, needs_ocr boolean, needs_parse boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Documents(StatefulProcessor):
    """One document's state; lives in a task."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", STATE)

    def _load(self) -> dict[str, Any]:
        names = [x.split()[0] for x in STATE.split(", ")]
        held = self.state.get() if self.state.exists() else None
        return dict(zip(names, held, strict=True)) if held else dict.fromkeys(names) | {"has_receipt": False}

    def _save(self, s: dict[str, Any]) -> None:
        self.state.update(tuple(s.values()))

    def _wait(self, s: dict[str, Any], due: int | None) -> None:
        if s["due"] is not None:
            self.handle.deleteTimer(s["due"])
        if due is not None:
            self.handle.registerTimer(due)
        s["due"] = due

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        for r in sorted(rows, key=lambda r: (r.at, r.outcome is not None, r.outcome or "", r.content_hash or "", bool(r.tagged))):
            if r.outcome is None:
                out = self._arrive(s, r)
            else:
                out = self._end(s, r)
            if out:
                yield Row(doc_id=key[0], at=r.at, **out)
        self._save(s)

    def _arrive(self, s: dict[str, Any], r: Row) -> dict[str, Any]:
        changed = r.content_hash is not None and r.content_hash != s["content_hash"]
        forced = not r.tagged and s["has_receipt"]
        known = s["content_hash"] is not None
        needs_ocr = not (r.has_text and not forced) and (forced or changed or not known or not r.has_text)
        needs_parse = r.content_hash is not None and (r.content_hash != s["parse_hash"] or forced)
        s["content_hash"] = r.content_hash
        message = None
        if r.content_hash is None:
            s["status"], message = "skipped", "No usable text"
            self._wait(s, None)
        elif needs_parse:
            s["status"], s["waiting_hash"] = "processing", r.content_hash
            self._wait(s, r.ms + self.timeout_ms)
        elif s["status"] != "processing":
            s["status"] = "done"
        return {"status": s["status"], "error_message": message, "content_changed": changed, "forced": forced, "needs_ocr": needs_ocr, "needs_parse": needs_parse}

    def _end(self, s: dict[str, Any], r: Row) -> dict[str, Any] | None:
        if s["status"] != "processing":
            return None  # late, or of a document that never came
        self._wait(s, None)
        s["status"] = r.outcome
        if r.outcome == "done":
            s["parse_hash"], s["has_receipt"] = s["waiting_hash"], True
        return {"status": r.outcome, "error_message": None, "content_changed": False, "forced": False, "needs_ocr": False, "needs_parse": False}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        import datetime

        s, due = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if s["status"] == "processing" and s["due"] == due:
            s["status"], s["due"] = "error", None
            self._save(s)
            at = datetime.datetime.fromtimestamp(due / 1000)
            yield Row(doc_id=key[0], at=at, status="error", error_message="timed_out", content_changed=False, forced=False, needs_ocr=False, needs_parse=False)

    def close(self) -> None:
        pass


def follow(events: DataFrame, *, timeout: float = 300.0, delay: str = "1 minute") -> DataFrame:
    """The rows of a stream of events (EVENTS); timeout in seconds, delay how late rows may come."""
    body = strip(F.coalesce("text", F.lit("")))
    rows = events.withWatermark("at", delay).select(
        "doc_id", "at", F.unix_millis("at").alias("ms"), content_hash(body).alias("content_hash"), (F.length(body) >= MIN_TEXT_CHARS).alias("has_text"), F.coalesce("tagged", F.lit(False)).alias("tagged"), "outcome"
    )
    return rows.groupBy("doc_id").transformWithState(Documents(int(timeout * 1000)), ROWS, "Append", "EventTime")


def start(spark: SparkSession, source: str, checkpoint: str, target: str, *, timeout: float = 300.0, delay: str = "1 minute", name: str = "document-states") -> StreamingQuery:
    """Follows all new files of source once, adds the rows to target and stops. Needs the session's state store to be RocksDB's, which it sets."""
    if any(q.name == name for q in spark.streams.active):
        raise RuntimeError(f"{name} is running")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100).parquet(source)
    out = follow(events, timeout=timeout, delay=delay).writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).format("parquet").start(target)
