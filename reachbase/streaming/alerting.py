"""Alerts and completions as streams: state for each key, cool-downs as timers, and runs that an event closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DECIDED = "alert string, seq long, transition string, folds int"
_ALERT = "status string, told string, told_us long, folds int, due_us long"


def _transition(status: str | None, told: str | None, told_us: int, row, cooldown_us: int, us: int) -> str:
    if row.ends:
        return "resolved" if status == "open" else "ignored"
    if not row.enabled:
        return "suppressed_disabled"
    if status is None:
        return "raised"
    if status == "resolved":
        return "reopened"
    if told == row.digest:
        return "suppressed_identical"
    return "suppressed_cooldown" if us < told_us + cooldown_us else "repeated"


def decisions(stream: DataFrame, cooldown_seconds: int, late: str = "1 hour") -> DataFrame:
    """alert, seq, transition, folds from a stream of (alert, seq, at, digest, ends, enabled): what ``alerts.decide`` says of the same events.

    Each alert keeps its status and what was last told; no list of its events is held.  When the watermark passes the end
    of a cool-down in which events were folded away, a timer says ``cooldown_over`` with their number (seq null), and
    changes nothing: the next event is decided as it would have been.  Events of an alert that arrive in one trigger are
    taken in the order of seq, those of later triggers after them; an event older than the watermark is not dropped here.
    """
    cooldown = cooldown_seconds * 1_000_000

    def decide(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        status, told, told_us, folds, due = held.get if held.exists else (None, None, 0, 0, 0)
        status, told = status or None, told or None
        if held.hasTimedOut:
            held.update((status or "", told or "", told_us, folds, 0))
            yield pd.DataFrame([(key[0], None, "cooldown_over", folds)], columns=["alert", "seq", "transition", "folds"]).astype({"seq": "Int64"})
            return
        out = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for row in rows.itertuples():
            us = int(row.at.value // 1000)
            move = _transition(status, told, told_us, row, cooldown, us)
            quiet = move.startswith("suppressed")
            out.append((key[0], row.seq, move, folds + 1 if quiet or move == "repeated" else 0))
            if move in ("raised", "reopened", "repeated"):
                status, told, told_us, folds, due = "open", row.digest, us, 0, 0
            elif quiet:
                folds += 1
                if move == "suppressed_cooldown":
                    due = told_us + cooldown
            elif move == "resolved":
                status, due = "resolved", 0
        held.update((status or "", told or "", told_us, folds, due))
        if due:
            held.setTimeoutTimestamp(max(due // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["alert", "seq", "transition", "folds"]).astype({"seq": "Int64"})

    return stream.withWatermark("at", late).groupBy("alert").applyInPandasWithState(decide, _DECIDED, _ALERT, "append", GroupStateTimeout.EventTimeTimeout)


_CLOSED = "run_id string, event string, status string, batches int, readings long"
_RUN = "claimed string, mark long, batches string, readings long, expected int, done boolean"


def runs(stream: DataFrame) -> DataFrame:
    """run_id, event, status, batches, readings from a stream of envelopes (run_id, kind, batch_id, readings, mark, expected, claimed, arrival).

    ``kind`` is batch or completion.  A completion closes its run and says what it is worth: a claim of success with fewer batches than
    announced is partial, and waits open: a batch that comes late completes it (``late_batch``), or reopens nothing.  A batch that was
    seen is ``repeated``.  ``mark`` is the issuer's checkpoint: one that goes back is ``refused`` and does not count.  The
    state of a run is closed by its completion and not by a watermark.
    """

    def follow(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        claimed, mark, names, readings, expected, done = held.get if held.exists else ("", -1, "", 0, -1, False)
        seen = set(names.split("\n")) - {""}
        out = []
        for row in pd.concat(list(parts)).sort_values("arrival").itertuples():
            if row.kind == "batch":
                if row.batch_id in seen:
                    event = "repeated"
                elif row.mark < mark:
                    event = "refused"
                else:
                    seen.add(row.batch_id)
                    mark, readings = int(row.mark), readings + int(row.readings)
                    event = "late_batch" if claimed else "batch"
            elif claimed:
                event = "repeated"
            else:
                event, claimed, expected = "completed", row.claimed, int(row.expected)
            done = bool(claimed) and len(seen) >= expected
            status = "running" if not claimed else "partial" if claimed == "succeeded" and not done else claimed
            out.append((key[0], event, status, len(seen), readings))
        held.update((claimed, mark, "\n".join(sorted(seen)), readings, expected, done))
        yield pd.DataFrame(out, columns=["run_id", "event", "status", "batches", "readings"])

    return stream.groupBy("run_id").applyInPandasWithState(follow, _CLOSED, _RUN, "append", GroupStateTimeout.NoTimeout)
