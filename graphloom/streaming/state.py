"""Stateful operators on event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Events that a session keeps.
CAPACITY = 256


def bounded_sessions(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Events (id, session_id, priority, at) that a session keeps after each batch: session_id, id, priority, at, kept.

    The state of a session is at most `capacity` events; beyond that the least by (priority, at, id) is evicted. Each batch
    gives the events that came into the state (kept true) and those that left it (kept false), so that a sink can
    follow by upserts. State never grows with the number of events.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(zip(*state.get)), columns=["id", "priority", "at"]) if state.exists else pd.DataFrame({"id": [], "priority": [], "at": []})
        held = held.astype({"id": "int64", "priority": "int64", "at": "int64"})
        before = set(held["id"])
        for pdf in batches:
            both = pd.concat([held, pdf[["id", "priority", "at"]]], ignore_index=True).drop_duplicates("id")
            held = both.sort_values(["priority", "at", "id"], ascending=False).head(capacity)
        after = set(held["id"])
        state.update((held["id"].tolist(), held["priority"].tolist(), held["at"].tolist()))
        came = held[~held["id"].isin(before)].assign(kept=True)
        gone = pd.DataFrame({"id": sorted(before - after)}, dtype="int64").assign(priority=0, at=0, kept=False)
        out = pd.concat([came, gone], ignore_index=True)
        out.insert(0, "session_id", key[0])
        yield out[["session_id", "id", "priority", "at", "kept"]]

    return events.groupBy("session_id").applyInPandasWithState(
        update,
        "session_id string, id long, priority long, at long, kept boolean",
        "ids array<long>, priorities array<long>, times array<long>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
