"""Write-back that survives lost tasks: every payload of a document is sent once and counted once.

A payload is known by its document and the hash of what is sent. Before a task sends one it appends a claim to a journal file of its own, together
with the outcome of the one before, so that the disk is waited for once a payload; the files lie in a folder that all executors mount. A task that Spark repeats reads the journals of its partition
first, and a run that is repeated folds all journals into the outcome table first, so what has an outcome is never sent again. A claim without an
outcome is in doubt: the task was lost between the two, with one payload at most. Such a payload is settled by asking the receiver
(``has``), or, without that, sent again; the hash goes along as an idempotency key either way.

The outcome table (document_id, payload_hash, status, tries) is Parquet, appended once at the end of a run, after which the journals go. Counts are
those of the table, whatever was tried how often. A payload that failed is tried again in the next run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.sources.folders import Files

OUTCOMES = "document_id long, payload_hash string, status string, tries int"


def payload_hash(rows: DataFrame) -> F.Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "document_id"])), 256)


def outcomes(rows: DataFrame, folder: str) -> DataFrame:
    """The outcome of every payload that was begun: sent if it ever was, else failed if that is known, else claimed. in_doubt: whether some claim of it had no outcome."""
    spark, files = rows.sparkSession, Files(rows.sparkSession, folder)
    found = spark.read.schema(OUTCOMES).parquet(f"{folder}/outcomes") if files.exists("outcomes") else spark.createDataFrame([], OUTCOMES)
    # The three words are in the order of the alphabet.
    return found.groupBy("document_id", "payload_hash").agg(F.max("status").alias("status"), F.max("tries").alias("tries"), F.bool_or(F.col("status") == "claimed").alias("in_doubt"))


def _fold(rows: DataFrame, folder: str) -> None:
    """Puts what the journals say into the outcome table and deletes them. If that fails between the two, the next fold adds the same rows again, which count once."""
    files = Files(rows.sparkSession, folder)
    if any(n.endswith(".jsonl") for n in files.names("journal")):
        said = rows.sparkSession.read.schema(OUTCOMES).json(f"{folder}/journal").where("status IS NOT NULL")
        said.groupBy("document_id", "payload_hash").agg(F.max("status").alias("status"), F.max("tries").alias("tries")).write.mode("append").parquet(f"{folder}/outcomes")
    files.delete("journal")


class Journal:
    """What a partition's attempts have claimed and done; lives in a task."""

    def __init__(self, folder: str, partition: int) -> None:
        os.makedirs(folder, exist_ok=True)
        self.claimed: set[tuple] = set()
        self.done: set[tuple] = set()
        for name in os.listdir(folder):
            if name.startswith(f"part-{partition}-"):
                with open(f"{folder}/{name}", encoding="utf-8") as lines:
                    for line in lines:
                        if line.endswith("\n"):  # one cut short was followed by nothing
                            x = json.loads(line)
                            (self.claimed if x["status"] == "claimed" else self.done).add((x["document_id"], x["payload_hash"]))
        self.waiting = ""
        self.file = open(f"{folder}/part-{partition}-{uuid.uuid4().hex}.jsonl", "a", encoding="utf-8")  # noqa: SIM115

    def note(self, key: tuple, status: str, tries: int = 0) -> None:
        """Notes a claim on disk, with the outcome before it; an outcome alone waits for the next claim or the end, as nothing is sent in between."""
        self.waiting += json.dumps({"document_id": key[0], "payload_hash": key[1], "status": status, "tries": tries}) + "\n"
        if status == "claimed":
            self.keep()

    def keep(self) -> None:
        if self.waiting:
            self.file.write(self.waiting)
            self.file.flush()
            os.fsync(self.file.fileno())
            self.waiting = ""

    def close(self) -> None:
        self.keep()
        self.file.close()


def deliver(rows: DataFrame, send: Callable[[Row, str], None], folder: str, *, has: Callable[[Row, str], bool] | None = None, tries: int = 3, wait: float = 1.0) -> dict[str, int]:
    """Sends rows (document_id and what is sent) that have not been sent, up to tries times each, and returns how many of them are sent and how many failed by the
    outcome table, those of earlier runs included. send and has get the row and its hash."""
    local = re.sub(r"^file:(//)?(?=/)", "", folder)
    if ":" in local.split("/")[0]:
        raise ValueError("journals need a folder that the executors mount")
    _fold(rows, folder)
    spark, files, name = rows.sparkSession, Files(rows.sparkSession, folder), f"todo-{uuid.uuid4().hex}"
    keyed = rows.withColumn("payload_hash", payload_hash(rows))
    known = outcomes(rows, folder).select("document_id", "payload_hash", F.col("status").alias("_status"), F.coalesce("in_doubt", F.lit(False)).alias("_in_doubt"))
    todo = keyed.dropDuplicates(["document_id", "payload_hash"]).join(known, ["document_id", "payload_hash"], "left").where("_status IS NULL OR _status != 'sent'").drop("_status")
    # As a table, so that a task that is repeated gets the same rows.
    todo.write.parquet(f"{folder}/{name}")
    todo = spark.read.schema(todo.schema).parquet(f"{folder}/{name}")

    def each(part: Iterator[Row]) -> None:
        journal = Journal(f"{local}/journal", TaskContext.get().partitionId())
        for r in part:
            key = (r["document_id"], r["payload_hash"])
            if key in journal.done:
                continue
            doubtful = r["_in_doubt"] or key in journal.claimed
            journal.note(key, "claimed")
            if doubtful and has and has(r, key[1]):
                journal.note(key, "sent")
                continue
            status, tried = "failed", 0
            while status == "failed" and tried < tries:
                tried += 1
                try:
                    send(r, key[1])
                    status = "sent"
                except Exception as e:
                    print(f"write-back of {key} failed: {e!r}", file=sys.stderr)
                    if tried < tries:
                        time.sleep(wait)
            journal.note(key, status, tried)
        journal.close()

    todo.foreachPartition(each)
    _fold(rows, folder)
    files.delete(name)
    asked = keyed.select("document_id", "payload_hash").distinct()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("sent", "failed")]
    return asked.join(outcomes(rows, folder), ["document_id", "payload_hash"]).agg(*counts).first().asDict()
