"""Sessions on streams by the same rules as in batches: a long gap, a change of label or of subject ends one.

Each project keeps its edits that may still be overtaken by late ones, the session that is open and the number of the next. Edits are taken
into sessions in order of (ts, tie) once the watermark has passed them; rows that come after later ones were taken are left out. A session is
given out when an edit that breaks from it is taken, or, by a timer, when the watermark has passed its last edit by more than the gap;
then only the session's number and its last edit stay, and they expire after `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from draftlens.session import ship_package
from draftlens.vocab import SESSION_COSINE, SESSION_GAP_MINUTES

RESULT = "project int, session long, start_ts timestamp, end_ts timestamp, n long, label string, closed_by string"
_EDIT = "us long, tie long, label string, likeness double"
_OPEN = "session long, start long, end long, tie long, n long, label string, last_label string"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _micros(ts: pd.Series) -> list[int]:
    return pd.DatetimeIndex(ts).tz_localize(None).as_unit("us").asi8.tolist()


class SessionProcessor(StatefulProcessor):
    """State of a project: waiting edits, the open session, and when its timer is due."""

    def __init__(self, gap: float, label_breaks: bool, least_similarity: float | None, keep_ms: int):
        self.gap, self.label_breaks, self.least, self.keep = round(gap * 60_000_000), label_breaks, least_similarity, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EDIT)
        self.open = handle.getValueState("open", _OPEN)

    def _cause(self, open_: tuple, edit: tuple) -> str | None:
        """Why the edit does not belong to the session."""
        if edit[0] - open_[2] > self.gap:
            return "gap"
        if self.label_breaks and edit[2] != open_[6]:
            return "label"
        if self.least is not None and edit[3] is not None and edit[3] < self.least:
            return "similarity"
        return None

    def _advance(self, key: tuple, watermark_ms: int, fresh: list[tuple]) -> list[tuple]:
        """Take what the watermark has passed; the sessions closed by that."""
        passed = watermark_ms * 1000
        edits = sorted([tuple(e) for e in self.waiting.get()] + fresh)
        open_ = tuple(self.open.get()) if self.open.exists() else None
        closed, held = [], []
        for edit in edits:
            if edit[0] > passed:
                held.append(edit)
                continue
            us, tie, label, _ = edit
            if open_ and (us, tie) <= open_[2:4]:
                continue  # later ones were taken before it came
            cause = self._cause(open_, edit) if open_ else None
            if open_ and cause is None and open_[4]:
                open_ = (open_[0], open_[1], us, tie, open_[4] + 1, open_[5], label)
                continue
            if open_ and open_[4]:
                closed.append((key[0], open_, cause))
            open_ = (open_[0] + 1 if open_ else 0, us, us, tie, 1, label, label)
        if open_ and open_[4] and passed - open_[2] > self.gap:
            closed.append((key[0], open_, "gap"))
            open_ = (*open_[:4], 0, open_[5], open_[6])
        if held:
            self.waiting.put(held)
        elif self.waiting.exists():
            self.waiting.clear()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if open_:
            self.open.update(open_)
        if held:
            self.handle.registerTimer(max(held[0][0] // 1000 + 1, watermark_ms + 1))
        elif open_ and open_[4]:
            self.handle.registerTimer((open_[2] + self.gap) // 1000 + 1)
        elif open_:
            if passed // 1000 - open_[2] // 1000 > self.keep:
                self.open.clear()
            else:
                self.handle.registerTimer(open_[2] // 1000 + self.keep + 1)
        return closed

    def _rows(self, closed: list[tuple]) -> Iterator[pd.DataFrame]:
        if closed:
            at = lambda us: _EPOCH + timedelta(microseconds=us)
            names = [f.split(" ")[0] for f in RESULT.split(", ")]
            yield pd.DataFrame([(p, s[0], at(s[1]), at(s[2]), s[4], s[5], cause) for p, s, cause in closed], columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            likeness = [None if pd.isna(x) else float(x) for x in batch["likeness"]]
            labels = [None if pd.isna(x) else x for x in batch["label"]]
            fresh += zip(_micros(batch["ts"]), batch["tie"].astype("int64").tolist(), labels, likeness, strict=True)
        yield from self._rows(self._advance(key, timerValues.getCurrentWatermarkInMs(), fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._rows(self._advance(key, timerValues.getCurrentWatermarkInMs(), []))

    def close(self) -> None:
        pass


def stream_sessions(edits: DataFrame, gap: float = SESSION_GAP_MINUTES, label_breaks: bool = False, least_similarity: float | None = None, late: str = "10 minutes", keep: timedelta = timedelta(days=30)) -> DataFrame:
    """Closed sessions of a stream of edits (project, ts, tie, label, likeness: to the project's edit before, or null).

    With least_similarity (SESSION_COSINE is the batch's default) an edit less like the one before it begins a session. A session that a gap closes
    is given out by the watermark alone, without another edit. Edits without a time are left out. Needs the RocksDB state store.
    """
    ship_package(edits.sparkSession)
    rows = edits.select("project", "ts", "tie", "label", "likeness").filter("ts is not null").withWatermark("ts", late)
    made = SessionProcessor(gap, label_breaks, least_similarity, int(keep.total_seconds() * 1000))
    return rows.groupBy("project").transformWithStateInPandas(statefulProcessor=made, outputStructType=RESULT, outputMode="append", timeMode="eventTime")


__all__ = ["SESSION_COSINE", "SessionProcessor", "stream_sessions"]
