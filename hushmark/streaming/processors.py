"""Stateful rules per document, as processors over typed state that event-time timers end.

Events may come in any order. The time column is handed over as a plain number, so Spark's late-row filter leaves all rows to the rule, which
says what becomes of those behind the watermark. Each processor keeps only what the watermark has not passed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_LONGS = "version long, conflicts long"


class VersionFold(StatefulProcessor):
    """Decisions in the order of their time: one made for the current version raises it, all others are conflicts.

    An event waits until the watermark has passed it, so that none before it is still to come. One that comes later than that
    is judged against the version of the moment it comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", _LONGS)
        self.waiting = handle.getListState("waiting", "ts long, event_id long, version long")

    def _judge(self, claims: list[int]) -> tuple[int, int]:
        current, conflicts = self.fold.get() if self.fold.exists() else (1, 0)
        for claimed in claims:
            current, conflicts = (current + 1, conflicts) if claimed == current else (current, conflicts + 1)
        self.fold.update((current, conflicts))
        return current, conflicts

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # a heartbeat, which only moves the watermark
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        late, first = [], None
        for row in rows:
            if row.ts < mark:
                late.append((row.ts, row.event_id, row.version))
            else:
                self.waiting.appendValue((row.ts, row.event_id, row.version))
                first = row.ts if first is None else min(first, row.ts)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        if late:
            version, conflicts = self._judge([v for _, _, v in sorted(late)])
            yield Row(doc_id=key[0], version=version, conflicts=conflicts)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(w) for w in self.waiting.get())
        ripe = [w for w in waiting if w[0] < mark]
        if not ripe:  # an earlier timer of the same batch has folded them
            return
        rest = waiting[len(ripe) :]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        version, conflicts = self._judge([v for _, _, v in ripe])
        yield Row(doc_id=key[0], version=version, conflicts=conflicts)

    def close(self) -> None:
        pass


class Lifetime(StatefulProcessor):
    """Whether an event lies within its document's lifetime, which runs from its creation and does not slide.

    Events that come before the creation wait until the watermark has passed them: then no creation before them is still to come, and they
    are expired. The creation is kept until the watermark has passed the end of the lifetime. An event behind the watermark
    without a creation in the state comes out unjudged; the creation table decides it.
    """

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.created = handle.getValueState("created", "ts long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long")

    def _row(self, key: tuple, ts: int, event_id: int, created: int | None, accepted: bool | None) -> Row:
        return Row(doc_id=key[0], event_id=event_id, ts=ts, created=created, accepted=accepted)

    def _alive(self, ts: int, created: int) -> bool:
        return created <= ts <= created + self.micros

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        created = self.created.get()[0] if self.created.exists() else None
        unknown = []
        for row in rows:
            if created is None and row.creates:
                created = row.ts
                self.created.update((created,))
                self.handle.registerTimer((created + self.micros) // 1000 + 1)
            if created is None:
                unknown.append((row.ts, row.event_id))
            else:
                yield self._row(key, row.ts, row.event_id, created if row.creates else None, self._alive(row.ts, created))
        if created is not None:
            unknown += [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
            self.waiting.clear()
            for ts, event_id in unknown:
                yield self._row(key, ts, event_id, None, self._alive(ts, created))
            return
        for ts, event_id in unknown:
            if ts < mark:
                yield self._row(key, ts, event_id, None, None)
            else:
                self.waiting.appendValue((ts, event_id))
        if unknown:
            self.handle.registerTimer(max(min(ts for ts, _ in unknown), mark) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.created.exists():
            if self.created.get()[0] + self.micros < mark:
                self.created.clear()
            return
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        ripe = [w for w in waiting if w[0] < mark]
        rest = waiting[len(ripe) :]
        if ripe and rest:
            self.waiting.put(rest)
        elif ripe:
            self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        for ts, event_id in ripe:
            # Either no creation has come, or one whose lifetime the watermark had passed before this event came.
            yield self._row(key, ts, event_id, None, False)

    def close(self) -> None:
        pass
