"""Tracks mixed into windows as their segments arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

MIXED = "mixer_id long, arrival long, kind string, track string, start long, pcm array<double>"
STORE, PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Mixer(StatefulProcessor):
    """The state of a mixer: its cursor; gain and mute of each track; and each waiting segment by track and number, so that an event writes what it changes and no more."""

    def __init__(self, window: int, lookahead: int, delay: int, idle: int | None):
        self.window, self.lookahead, self.delay, self.idle = window, lookahead, delay, idle

    def init(self, handle) -> None:
        self.handle = handle
        ttl = self.idle
        self.clock = handle.getValueState("clock", "cursor long, made long, due long", ttl)
        self.tracks = handle.getMapState("tracks", "track string", "gain double, mute boolean", ttl)
        self.segments = handle.getMapState("segments", "track string, number long", "start long, pcm array<double>", ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cursor, made, due = self.clock.get() if self.clock.exists() else (0, 0, 0)
        for e in sorted(rows, key=lambda e: e.arrival):
            known = e.track is not None and self.tracks.containsKey((e.track,))
            if e.kind == "add" and not known and e.track:
                self.tracks.updateValue((e.track,), (e.value or 1.0, False))
            elif e.kind in ("gain", "mute") and known:
                gain, mute = self.tracks.getValue((e.track,))
                self.tracks.updateValue((e.track,), (e.value or 0.0, mute) if e.kind == "gain" else (gain, bool(e.value)))
            elif e.kind == "remove" and known:
                self.tracks.removeKey((e.track,))
                for at in [k for k in self.segments.keys() if k[0] == e.track]:
                    self.segments.removeKey(tuple(at))
            elif e.kind == "segment" and e.pcm and e.start is not None and e.start >= 0:
                late, early = e.start + len(e.pcm) <= cursor, e.start > cursor + self.lookahead
                verdict = "late" if late else "early" if early else "taken" if known else "unknown"
                if verdict == "taken":
                    self.segments.updateValue((e.track, made), (e.start, list(e.pcm)))
                    made += 1
                    if self.delay and not due:
                        due = timerValues.getCurrentProcessingTimeInMs() + self.delay
                        self.handle.registerTimer(due)
                yield Row(mixer_id=key[0], arrival=e.arrival, kind=verdict, track=e.track, start=e.start, pcm=None)
            elif e.kind == "tick":
                yield self._mixed(key[0], e.arrival, cursor)
                cursor += self.window
        self.clock.update((cursor, made, due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cursor, made, _ = self.clock.get()
        yield self._mixed(key[0], None, cursor)
        self.clock.update((cursor + self.window, made, 0))
        if next(iter(self.segments.keys()), None) is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.delay
            self.clock.update((cursor + self.window, made, due))
            self.handle.registerTimer(due)

    def _mixed(self, mixer: int, arrival: int | None, begin: int) -> Row:
        """The window from here on; segments that end within it are let go."""
        end, total = begin + self.window, np.zeros(self.window)
        levels = {k[0]: 0.0 if mute else gain for k, (gain, mute) in self.tracks.iterator()}
        for at, (start, pcm) in list(self.segments.iterator()):
            a, b = max(start, begin), min(start + len(pcm), end)
            if a < b:
                total[a - begin : b - begin] += levels.get(at[0], 0.0) * np.array(pcm[a - start : b - start])
            if start + len(pcm) <= end:
                self.segments.removeKey(tuple(at))
        return Row(mixer_id=mixer, arrival=arrival, kind="mixed", track=None, start=begin, pcm=total.tolist())

    def close(self) -> None:
        pass


def mix_arrivals(events: DataFrame, window: int, lookahead: int, delay: int = 0, idle: int | None = None) -> DataFrame:
    """A streaming events(mixer_id, arrival, kind, track, start, value, pcm) to what comes of them: mixer_id, arrival, kind, track, start, pcm.

    Events of a mixer are taken by arrival. `add` a track with the gain `value` (null or 0: 1), set its `gain`, `mute` it (value not 0), `remove`
    it with all it holds; a `segment` of samples from `start` is `late` where it ends at or before the mixer's cursor, `early` where it starts more
    than `lookahead` past it, `unknown` without its track, else `taken`; looked at in this order. A `tick` gives `mixed`: the next window, the sum
    of gain times samples of all tracks that aren't mute, and moves the cursor behind it; segments that end there are let go. Only
    segments and ticks give rows; events without a mixer are put aside, and so are segments without samples or that start before 0.

    With a playout delay in milliseconds no tick is needed: so long after a first segment came a timer gives a window (its arrival is null), and so on while
    segments wait. State that isn't touched for `idle` milliseconds is dropped. A mixer holds the segments from its cursor to `lookahead` past it; a task
    holds what one trigger brings of a mixer, which the source's rate option bounds. The session's state store becomes RocksDB, which the operator needs."""
    events.sparkSession.conf.set(STORE, PROVIDER)
    rows = events.filter("mixer_id is not null and arrival is not null").select("mixer_id", "arrival", "kind", "track", "start", "value", "pcm")
    timed = "ProcessingTime" if delay or idle else "None"
    return rows.groupBy("mixer_id").transformWithState(Mixer(window, lookahead, delay, idle), MIXED, "append", timed)
