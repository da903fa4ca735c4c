"""The conversion queue as a state machine, folded over commands in a batch or in a stream.

States: waiting, awaitingConfirmation, converting, done, failed, cancelled. A command that doesn't fit the state changes
nothing; a path is added again only if it isn't waiting or converting.
"""
from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("done", "failed", "cancelled")
# state before, command -> state after; "" is no entry
MOVES = {
    ("", "add"): "waiting", **{(s, "add"): "waiting" for s in (*FINISHED, "awaitingConfirmation")}, ("waiting", "start"): "converting",
    ("waiting", "large"): "awaitingConfirmation", ("awaitingConfirmation", "confirm"): "converting", ("awaitingConfirmation", "decline"): "cancelled",
    ("converting", "finish"): "done", ("converting", "fail"): "failed", ("converting", "cancel"): "cancelled", ("waiting", "cancel"): "cancelled",
    ("failed", "retry"): "waiting", ("cancelled", "retry"): "waiting", **{(s, "remove"): "" for s in FINISHED}, **{(s, "clear"): "" for s in FINISHED},
}
SCHEMA = "path STRING, state STRING, applied BIGINT, ignored BIGINT, finished_at TIMESTAMP"


def step(state: tuple, command: str, ts) -> tuple:
    """(state, applied, ignored, finished_at) after a command."""
    now, applied, ignored, finished = state
    nxt = MOVES.get((now, command))
    if nxt is None:
        return now, applied, ignored + 1, finished
    # only the running entry's end is stamped
    return nxt, applied + 1, ignored, ts if nxt in FINISHED and now == "converting" else (None if nxt == "waiting" else finished)


def fold(commands: DataFrame) -> DataFrame:
    """(path, state, applied, ignored, finished_at) of commands (path, seq, command, ts), in the order of seq by path."""

    def run(key, pdf):
        state = ("", 0, 0, None)
        for r in pdf.sort_values("seq").itertuples():
            state = step(state, r.command, r.ts)
        return pd.DataFrame([(key[0], *state)], columns=["path", "state", "applied", "ignored", "finished_at"]).astype({"finished_at": "datetime64[ns]"})

    return commands.groupBy("path").applyInPandas(run, SCHEMA)


def commands_of_events(events: DataFrame) -> DataFrame:
    """Commands made of events: the user is the path, the id chooses the command."""
    names = F.array(*[F.lit(c) for c in ("add", "start", "finish", "fail", "cancel", "retry", "large", "confirm", "decline", "remove")])
    return events.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"),
                         F.get(names, (F.col("event_id") % 10).cast("int")).alias("command"), F.to_timestamp("ts").alias("ts"))


class Queue(StatefulProcessor):
    """The same fold on a stream: the state of a path lives in the state store and each batch emits it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("queue", "state STRING, applied BIGINT, ignored BIGINT, finished_at TIMESTAMP")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterable[pd.DataFrame]:
        state = tuple(self.kept.get()) if self.kept.exists() else ("", 0, 0, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            state = step(state, r.command, r.ts.to_pydatetime())
        self.kept.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["path", "state", "applied", "ignored", "finished_at"]).astype({"finished_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def stream(commands: DataFrame) -> DataFrame:
    """The queue over a stream of commands (path, seq, command, ts); needs the RocksDB state store."""
    return commands.groupBy("path").transformWithStateInPandas(Queue(), outputStructType=SCHEMA, outputMode="Update", timeMode="None")
