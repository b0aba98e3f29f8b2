"""Live updates: periodic re-listing, and change streams read by Structured Streaming, through the same update as a batch."""

from __future__ import annotations

import asyncio
import logging
import threading
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from indexflow.flow import Flow, session
from indexflow.plans.update import SourceStats, UpdateStats


log = logging.getLogger(__name__)
#: Seconds between tries when an update or a change stream fails.
FIRST_PAUSE, LONGEST_PAUSE = 5.0, 60.0


@dataclass
class FlowLiveUpdaterOptions:
    live_mode: bool = True
    print_stats: bool = False


@dataclass
class StatusUpdates:
    active_sources: list[str]
    updated_sources: list[str]


@dataclass
class _Task:
    source: str
    every: float | None
    stream: DataFrame | None
    wait_for: Any = None
    stats: SourceStats = field(default_factory=SourceStats)
    active: bool = True


class FlowLiveUpdater:
    """Keeps a flow's targets up to date until it is stopped, or updates them once where nothing is live."""

    def __init__(self, flow: Flow, options: FlowLiveUpdaterOptions | None = None):
        self.flow, self.options = flow, options or FlowLiveUpdaterOptions()
        self._tasks: list[_Task] = []
        self._threads: list[threading.Thread] = []
        self._queries: list[StreamingQuery] = []
        self._stop, self._news = threading.Event(), threading.Condition()
        self._changed: set[str] = set()
        self._errors: list[Exception] = []

    def start(self) -> None:
        for name, (spec, _, interval) in self.flow.builder().sources.items():
            live = self.options.live_mode
            stream = spec.change_stream(session()) if live and hasattr(spec, "change_stream") else None
            self._tasks.append(_Task(name, interval.total_seconds() if live and interval else None, stream, getattr(spec, "wait_for", None) if live else None))
        for task in self._tasks:
            t = threading.Thread(target=self._run, args=(task,), daemon=True, name=f"live-{task.source}")
            self._threads.append(t)
            t.start()

    def _run(self, task: _Task) -> None:
        try:
            live = bool(task.every or task.wait_for or task.stream is not None)
            self._lasting(lambda: self._pass(task), task, live)
            due = time.monotonic()
            while task.every and not self._stop.is_set():
                due = max(due + task.every, time.monotonic())
                if self._stop.wait(max(0, due - time.monotonic())):
                    break
                self._lasting(lambda: self._pass(task), task)
            while task.wait_for is not None and not self._stop.is_set():
                # after a failure the news isn't confirmed: it comes again
                self._lasting(lambda: task.wait_for(lambda: self._pass(task)), task)
            while task.stream is not None and not task.every and not self._stop.is_set():
                self._lasting(lambda: self._follow(task), task)
        except Exception as bad:
            self._errors.append(bad)
        finally:
            with self._news:
                task.active = False
                self._news.notify_all()

    def _lasting(self, work: Any, task: _Task, live: bool = True) -> None:
        """Do the work, again after ever longer pauses where it fails and the source is live."""
        pause = FIRST_PAUSE
        while not self._stop.is_set():
            try:
                work()
                return
            except Exception as bad:
                if not live:
                    raise
                log.warning("changes of %s: %s", task.source, bad)
                self._stop.wait(pause)
                pause = min(LONGEST_PAUSE, 2 * pause)

    def _follow(self, task: _Task) -> None:
        """Run the change stream from where its checkpoint says until it fails or all is stopped."""
        stream = self.flow.builder().sources[task.source][0].change_stream(session())
        place = f"{self.flow.state.root}/streams/{task.source}"
        query = stream.writeStream.option("checkpointLocation", place).foreachBatch(lambda df, _: self._pass(task) if not df.isEmpty() else None).start()
        self._queries.append(query)
        while not self._stop.wait(0.5):
            if not query.isActive:
                self._queries.remove(query)
                if query.exception():
                    raise query.exception()
                return

    def _pass(self, task: _Task) -> None:
        stats: UpdateStats = self.flow.update_async(only={task.source}).result() if len(self._tasks) == 1 else self.flow.update()
        with self._news:
            for name, s in stats.sources.items():
                own = next(t for t in self._tasks if t.source == name)
                own.stats = SourceStats(s.no_change, *(getattr(own.stats, f) + getattr(s, f) for f in ("insertions", "deletions", "updates", "reprocesses", "errors")))
                if s.changed:
                    self._changed.add(name)
            self._news.notify_all()
        if self.options.print_stats:
            print(stats)

    def next_status_updates(self, timeout: float | None = None) -> StatusUpdates:
        """Wait for a source to change or to end; the sources still active, and those changed since the last call."""
        with self._news:
            active = lambda: [t.source for t in self._tasks if t.active]
            self._news.wait_for(lambda: self._changed or not active(), timeout)
            changed, self._changed = sorted(self._changed), set()
            return StatusUpdates(active(), changed)

    async def next_status_updates_async(self) -> StatusUpdates:
        return await asyncio.to_thread(self.next_status_updates)

    def update_stats(self) -> UpdateStats:
        return UpdateStats({t.source: t.stats for t in self._tasks})

    def wait(self) -> None:
        for t in self._threads:
            t.join()
        if self._errors:
            raise self._errors[0]

    async def wait_async(self) -> None:
        await asyncio.to_thread(self.wait)

    def abort(self) -> None:
        self._stop.set()
        for q in self._queries:
            q.stop()

    def __enter__(self) -> FlowLiveUpdater:
        self.start()
        return self

    def __exit__(self, *_: Any) -> None:
        self.abort()
        self.wait()

    async def __aenter__(self) -> FlowLiveUpdater:
        self.start()
        return self

    async def __aexit__(self, *_: Any) -> None:
        self.abort()
        await self.wait_async()


def upsert_stream(stream: DataFrame, keys: list[str], order: str, save: Any, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keep the latest row of each key of a stream: every micro-batch is merged into the stored table by ``save(batch, batch_id)``."""
    from indexflow.operators.merge import last_writer

    def apply(batch: DataFrame, batch_id: int) -> None:
        save(last_writer(batch, keys, [F.col(order).desc()]), batch_id)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
