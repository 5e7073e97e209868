"""Write-back with lost tasks: a task that dies mid-way sends and counts nothing twice."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import delivery


def received(folder):
    path = f"{folder}/received"
    return Counter(open(path).read().split()) if os.path.exists(path) else Counter()


def sender(folder, *, dies_at=None, before=True, fails=()):
    """A receiver that appends documents to a file. The worker that gets dies_at dies once, before or after it has sent."""

    def send(row, key):
        mark = f"{folder}/died"
        dies = row["document_id"] == dies_at and not os.path.exists(mark)
        if dies and before:
            open(mark, "w").close()
            os._exit(1)
        if row["document_id"] in fails and not os.path.exists(f"{folder}/healed"):
            raise OSError("no")
        with open(f"{folder}/received", "a") as out:
            out.write(f"{row['document_id']}:{row['title']}\n")
        if dies:
            open(mark, "w").close()
            os._exit(1)

    return send


@pytest.fixture
def rows(spark):
    return spark.range(60).select(F.col("id").alias("document_id"), F.concat(F.lit("t"), "id").alias("title")).repartition(3)


@pytest.mark.parametrize("before", [True, False])
def test_a_lost_task_sends_and_counts_nothing_twice(spark, rows, tmp_path, before):
    folder = f"file://{tmp_path}/w"
    with pytest.raises(Exception, match="crash|exit|EOF|reset|Worker"):
        delivery.deliver(rows, sender(tmp_path, dies_at=30, before=before), folder)
    half = received(tmp_path)
    assert 0 < len(half) < 60 or before
    has = lambda row, key: f"{row['document_id']}:{row['title']}" in received(tmp_path)
    assert delivery.deliver(rows, sender(tmp_path, dies_at=30, before=before), folder, has=has) == {"sent": 60, "failed": 0}
    assert received(tmp_path) == Counter(f"{i}:t{i}" for i in range(60))
    assert delivery.deliver(rows, sender(tmp_path), folder) == {"sent": 60, "failed": 0}
    assert sum(received(tmp_path).values()) == 60
    assert delivery.outcomes(rows, folder).where("in_doubt").count() == 1


def test_an_attempt_that_is_repeated_reads_the_journal_of_the_first(tmp_path):
    first = delivery.Journal(str(tmp_path), 4)
    first.note((1, "a"), "claimed")
    first.note((1, "a"), "sent", 1)
    first.note((2, "b"), "claimed")
    first.file.write('{"document_id": 3, "pay')
    first.file.flush()
    other = delivery.Journal(str(tmp_path), 40)
    again = delivery.Journal(str(tmp_path), 4)
    assert (again.done, again.claimed, other.claimed) == ({(1, "a")}, {(1, "a"), (2, "b")}, set())


def test_the_disk_is_waited_for_once_a_payload(tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr(delivery.os, "fsync", waits.append)
    journal = delivery.Journal(str(tmp_path), 1)
    for i in range(10):
        journal.note((i, "a"), "claimed")
        # Before a payload is sent its claim is on disk, and the outcome of every one before it.
        seen = delivery.Journal(str(tmp_path), 1)
        assert (len(seen.claimed), len(seen.done)) == (i + 1, i)
        journal.note((i, "a"), "sent", 1)
    journal.close()
    assert len(waits) == 11
    assert len(delivery.Journal(str(tmp_path), 1).done) == 10


def test_failures_are_counted_once_and_tried_again(spark, rows, tmp_path):
    folder = str(tmp_path / "w")
    assert delivery.deliver(rows.unionByName(rows), sender(tmp_path, fails={7, 8}), folder, tries=2, wait=0) == {"sent": 58, "failed": 2}
    assert delivery.outcomes(rows, folder).where("status = 'failed'").agg(F.sum("tries")).first()[0] == 4
    (tmp_path / "healed").touch()
    changed = rows.withColumn("title", F.when(F.col("document_id") == 9, "new").otherwise(F.col("title")))
    assert delivery.deliver(changed, sender(tmp_path, fails={7, 8}), folder) == {"sent": 60, "failed": 0}
    assert received(tmp_path) == Counter([f"{i}:t{i}" for i in range(60)] + ["9:new"])
    with pytest.raises(ValueError, match="mount"):
        delivery.deliver(rows, sender(tmp_path), "s3a://bucket/x")
