"""States of documents as a stream: stopped and started again after any file, it gives the rows of one run and of a plain loop."""

import datetime
import hashlib

from ledgerloom.streaming import states

T0 = datetime.datetime(2024, 5, 1, 12)
LONG = "a text of more than forty characters, number "


def event(doc, minute, text=None, tagged=True, outcome=None):
    return (doc, T0 + datetime.timedelta(minutes=minute), text, tagged, outcome)


FILES = [
    [event(1, 0, LONG + "1"), event(2, 0, LONG + "2"), event(3, 0, " "), event(4, 0, "short"), event(5, 1, LONG + "5")],
    [event(1, 1, outcome="done"), event(2, 2, outcome="error"), event(4, 2, outcome="done"), event(9, 2, outcome="done")],
    [event(1, 3, LONG + "1"), event(2, 3, LONG + "2"), event(3, 3, LONG + "3"), event(4, 3, "short", False)],
    [event(2, 4, outcome="done"), event(3, 4, LONG + "3b"), event(3, 5, outcome="done"), event(4, 4, outcome="skipped")],
    [event(6, 20, LONG + "6")],
    [event(5, 21, LONG + "5"), event(5, 22, outcome="done"), event(1, 22, LONG + "1", False), event(1, 23, outcome="done")],
    [event(7, 60, LONG + "7")],
    [event(8, 61, LONG + "8")],
]


def plain(files, timeout=5, delay=1):
    """The same by a loop: after each file the watermark moves to its greatest time less the delay, and what is due by then times out."""
    held, out = {}, []
    digest = lambda t: hashlib.sha256(t.strip().encode()).hexdigest() if t and t.strip() else None
    for rows in files:
        for doc, at, text, tagged, outcome in sorted(rows, key=lambda r: (r[1], r[4] is not None)):
            s = held.setdefault(doc, {"content": None, "parsed": None, "has": False, "status": None, "due": None})
            if outcome is None:
                h = digest(text)
                forced = not tagged and s["has"]
                changed = h is not None and h != s["content"]
                long = len((text or "").strip()) >= 40
                ocr = not (long and not forced) and (forced or changed or s["content"] is None or not long)
                parse = h is not None and (h != s["parsed"] or forced)
                s["content"] = h
                if h is None:
                    s["status"], s["due"] = "skipped", None
                elif parse:
                    s["status"], s["due"] = "processing", at + datetime.timedelta(minutes=timeout)
                elif s["status"] != "processing":
                    s["status"] = "done"
                out.append((doc, at, s["status"], "No usable text" if h is None else None, changed, forced, ocr, parse))
            elif s["status"] == "processing":
                s["status"], s["due"] = outcome, None
                if outcome == "done":
                    s["parsed"], s["has"] = s["content"], True
                out.append((doc, at, outcome, None, False, False, False, False))
        mark = max(r[1] for f in files[: files.index(rows) + 1] for r in f) - datetime.timedelta(minutes=delay)
        for doc, s in held.items():
            if s["status"] == "processing" and s["due"] <= mark:
                out.append((doc, s["due"], "error", "timed_out", False, False, False, False))
                s["status"], s["due"] = "error", None
    return sorted(out, key=repr)


def test_restarts_give_the_rows_of_a_plain_loop(spark, tmp_path):
    for rows in FILES:
        spark.createDataFrame(rows, states.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = states.start(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out"), timeout=300)
        assert query.awaitTermination(120)
    found = sorted((tuple(r) for r in spark.read.schema(states.ROWS).parquet(str(tmp_path / "out")).collect()), key=repr)
    assert found == plain(FILES)
    assert {r[2:4] for r in found} >= {("error", "timed_out"), ("skipped", "No usable text"), ("done", None)}
