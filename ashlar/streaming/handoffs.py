"""Hand-off state machine over a stream: one open hand-off a session, idempotent opens, resolves with a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "session_id long, id long, reason string, status string, created_at long, resolved_at long"
STATE = "id long, reason string, created_at long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    opened = state.get if state.exists else None
    out = []
    rows = pd.concat(list(batches)).sort_values(["at_ms", "event_id"])
    for row in rows.itertuples():
        if row.action == "open" and opened is None:
            opened = (int(row.event_id), row.reason, int(row.at_ms))
            out.append((key[0], *opened[:2], "open", opened[2], None))
        elif row.action == "resolve" and opened is not None:
            out.append((key[0], *opened[:2], "resolved", opened[2], int(row.at_ms)))
            opened = None
    if opened is not None:
        state.update(opened)
    elif state.exists:
        state.remove()
    frame = pd.DataFrame(out, columns=["session_id", "id", "reason", "status", "created_at", "resolved_at"])
    frame["resolved_at"] = frame["resolved_at"].astype("Int64")
    yield frame


def handoff_changes(events: DataFrame) -> DataFrame:
    """Changes of hand-offs from a stream of (event_id, session_id, action, reason, at_ms)."""
    return events.groupBy("session_id").applyInPandasWithState(_advance, OUT, STATE, "append", "NoTimeout")


def latest(changes: DataFrame) -> DataFrame:
    """The last state of every hand-off of a change log."""
    from pyspark.sql import functions as F

    last = F.max_by(F.struct("session_id", "reason", "status", "created_at", "resolved_at"), F.struct((F.col("status") == "resolved").cast("int").alias("s"), "created_at"))
    return changes.groupBy("id").agg(last.alias("x")).select("id", "x.*")


def session_changes(messages: DataFrame) -> DataFrame:
    """Sessions touched by a stream of (session_id, created_at): creation stays, the update time moves on."""
    from pyspark.sql import functions as F

    return messages.groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.count("*").alias("messages"))


TERMINAL = ("done", "error", "cancelled")


def job_stream(events: DataFrame, cursor: int = -1) -> DataFrame:
    """Events behind a cursor up to and with the job's first terminal one, from (job_id, seq, status) rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ended = F.min(F.when(F.col("status").isin(*TERMINAL), F.col("seq"))).over(Window.partitionBy("job_id"))
    return events.withColumn("_end", ended).where((F.col("seq") > cursor) & (F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))).drop("_end")
