"""Losses in streams of packets as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.streams import JUMP

SLOTS = "stream_id long, seq int, kind string, ago int"


def arrivals_with_losses(packets: DataFrame) -> DataFrame:
    """A streaming packets(stream_id, arrival, seq of 16 bits) to stream_id, seq, kind and ago.

    kind is `received`; `old` for a packet behind the one expected, which changes nothing; or `lost`, a row for each packet missing
    before one that came, ago counted back from it. Gaps of 100 and more are jumps without such rows. Numbers wrap at 65536. The state of
    a stream is one number; a task holds what one trigger brings of a stream, which the source's rate option bounds. Rows with a null
    stream or number are put aside; ties of arrival go by the number."""

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (expected,) = state.get if state.exists else (None,)
        out: list[tuple] = []
        for seq in pd.concat(list(frames)).sort_values(["arrival", "seq"])["seq"].astype(int):
            ahead = 0 if expected is None else (seq - expected) % 65536
            if ahead >= 32768:
                out.append((key[0], seq, "old", 0))
                continue
            if ahead < JUMP:
                out += [(key[0], (seq - ago) % 65536, "lost", ago) for ago in range(ahead, 0, -1)]
            out.append((key[0], seq, "received", 0))
            expected = (seq + 1) % 65536
        if expected is not None:
            state.update((expected,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "kind", "ago"])

    rows = packets.filter("stream_id is not null and seq is not null").select("stream_id", "arrival", "seq")
    return rows.groupBy("stream_id").applyInPandasWithState(follow, SLOTS, "expected int", "append", GroupStateTimeout.NoTimeout)
