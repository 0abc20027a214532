"""States of assignments kept on a stream of their events, with an alarm for reviews that never end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import STATE

STAGES = ("submitted", "reviewing", "scored")
FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: Times are numbers of microseconds within the processor, whatever the time zone of a session.
NUMBERS = STATE.replace("timestamp", "long")
KEPT = f"at long, {NUMBERS}"
UPDATE = f"id long, kind string, {KEPT}"


class AssignmentStates(StatefulProcessor):
    """The newest event of each assignment, as ``sources.current`` has it from all events.

    An event that comes late changes the state only if it is newer, equal times going by stage; the last hand-in time
    is the latest of all. While the newest event is a review, a timer waits for ``patience`` milliseconds of event time:
    if the assignment is still in the same review then, an alarm is told.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", KEPT)

    def _row(self, key: tuple, kind: str, kept: dict[str, Any]) -> Row:
        return Row(id=key[0], kind=kind, **kept)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        kept = dict(zip(["at", *FIELDS], self.now.get(), strict=True)) if self.now.exists() else None
        before = kept and (kept["at"], kept["status"])
        for r in rows:
            handed = [t for t in (r["submitted_at"], kept and kept["submitted_at"]) if t is not None]
            if kept is None or (r["us"], STAGES.index(r["status"])) >= (kept["at"], STAGES.index(kept["status"])):
                kept = {"at": r["us"], **{f: r[f] for f in FIELDS}}
            kept["submitted_at"] = max(handed, default=None)
        self.now.update(tuple(kept.values()))
        if (kept["at"], kept["status"]) != before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if kept["status"] == "reviewing":
                self.handle.registerTimer(kept["at"] // 1000 + self.patience)
        yield self._row(key, "state", kept)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        kept = dict(zip(["at", *FIELDS], self.now.get(), strict=True))
        if kept["status"] == "reviewing":
            yield self._row(key, "alarm", kept)

    def close(self) -> None:
        pass


def assignment_states(events: DataFrame, late: str = "30 days", patience: int = 86_400_000) -> DataFrame:
    """Updates (id, kind, at, state fields) from a stream of state events (``sources.submitted``, ``reviewing``, ``scored``).

    Kind ``state`` is the state after a batch in which the assignment had events; ``alarm`` tells that a review has
    lasted for ``patience`` milliseconds. Events later than ``late`` are dropped by the watermark. States are kept in
    RocksDB, so they need not fit in memory: set ``spark.sql.streaming.stateStore.providerClass`` as ``PROVIDER`` says.
    """
    times = [f.split()[0] for f in STATE.split(", ") if f.endswith("timestamp")]
    rows = events.withWatermark("at", late).withColumns({"us": F.unix_micros("at"), **{c: F.unix_micros(c) for c in times}})
    told = rows.groupBy("id").transformWithState(AssignmentStates(patience), UPDATE, "Update", "EventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("at", *times)})


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
