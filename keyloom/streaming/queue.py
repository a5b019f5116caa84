"""Blocking pops over a stream: waiters and items of a key meet in arrival order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "key string, req string, item string"
STATE = "items array<string>, waiters array<string>, due array<long>"


def blocking_pops(events: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """events: (key, kind "push" or "pop", id, at). One row for each answered pop; a pop that waits
    longer than ``timeout_ms`` (0: for ever) is answered with a null item."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, waiters, due = map(deque, state.get if state.exists else ([], [], []))
        out = []
        now = state.getCurrentProcessingTimeMs() if timeout_ms else 0
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame()
        if len(rows):
            for kind, id_ in rows.sort_values(["at", "id"])[["kind", "id"]].itertuples(index=False):
                if kind == "push":
                    items.append(id_)
                else:
                    waiters.append(id_)
                    due.append(now + timeout_ms)
                while items and waiters:
                    out.append((key[0], waiters.popleft(), items.popleft()))
                    due.popleft()
        while timeout_ms and due and due[0] <= now:
            out.append((key[0], waiters.popleft(), None))
            due.popleft()
        if items or waiters:
            state.update(tuple(map(list, (items, waiters, due))))
            if timeout_ms and due:
                state.setTimeoutDuration(max(1, due[0] - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "req", "item"])

    mode = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("key").applyInPandasWithState(step, RESULT, STATE, "append", mode)
