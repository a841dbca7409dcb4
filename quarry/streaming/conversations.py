"""Conversation state as a stateful processor: turns in a list state, event-time timers, a batch table to begin with.

Beside sessions.session_contexts(), whose idle sessions go by processing time: here a session's state goes when event time
has passed its last turn by the time to live, so a stream with availableNow ends, and a replay expires the same sessions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.sessions import MESSAGES, ROLES, TTL

TURN = "seq long, role string, text string, ts long"
OUT = "session_key string, seq long, context_turns int, context string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need; call it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Conversation(StatefulProcessor):
    """The last `most` live turns of a session."""

    def __init__(self, ttl: int, most: int) -> None:
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", TURN)
        self.last = handle.getValueState("last", "ts long")

    def _held(self) -> list[tuple]:
        return [tuple(t) for t in self.turns.get()] if self.turns.exists() else []

    def _keep(self, held: list[tuple]) -> None:
        """Replaces the turns, and moves the timer to when the newest of them is past its time."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not held:
            self.turns.clear()
            self.last.clear()
            return
        newest = max(t[3] for t in held)
        self.turns.put(held)
        self.last.update((newest,))
        self.handle.registerTimer((newest + self.ttl + 1) * 1000)

    def _live(self, held: list[tuple], now: int) -> list[tuple]:
        return [t for t in held if t[3] >= now - self.ttl][-self.most :]

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        if initialState.role in ROLES and initialState.text and initialState.ts is not None:
            held = sorted([*self._held(), (initialState.seq, initialState.role, initialState.text, initialState.ts)])
            self._keep(held[-self.most :])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        for r in sorted(rows, key=lambda r: (r.seq, r.ts)):
            if r.reset:
                held = []
            elif r.role in ROLES and r.text:
                held = [*held, (r.seq, r.role, " ".join(r.text.split())[:700], r.ts)]
            held = self._live(held, r.ts)
            yield Row(session_key=key[0], seq=r.seq, context_turns=len(held), context="\n".join(f"- {role}: {text}" for _, role, text, _ in held))
        self._keep(held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._keep([])
        return iter(())

    def close(self) -> None:
        pass


def live_contexts(turns: DataFrame, begin: DataFrame | None = None, ttl: int = TTL, most: int = MESSAGES, late: str = "1 day", at: Column | None = None) -> DataFrame:
    """(session_key, seq, context_turns, context) for each turn of a stream, with the live context after it.

    turns: session_key, seq, role, text, ts (seconds), reset (clears the session and isn't kept itself); begin: turns known
    before the stream begins, as a batch table. A session's turns are taken in order of seq within a batch, whatever the
    batches are. Turns without a time are never live and left out; those later than `late` behind the newest are dropped.
    """
    stamped = turns.where("ts is not null").withColumn("at", F.timestamp_seconds("ts") if at is None else at).withWatermark("at", late)
    known = None if begin is None else begin.select("session_key", "seq", "role", "text", "ts").groupBy("session_key")
    return stamped.groupBy("session_key").transformWithState(Conversation(ttl, most), OUT, "Append", "EventTime", known)
