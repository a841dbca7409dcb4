"""Conversation state as a stream: one keyed state per session, capped and expiring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.sessions import MESSAGES, ROLES, TTL

OUT = "session_key string, seq long, context_turns int, context string"
STATE = "roles array<string>, texts array<string>, stamps array<long>, seq long"


def session_contexts(turns: DataFrame, ttl: int = TTL, most: int = MESSAGES) -> DataFrame:
    """(session_key, seq, context_turns, context) for each turn of a stream, with the live context after it.

    turns: session_key, seq, role, text, ts, reset (clears the session and isn't kept itself). A session's turns are
    taken in order of seq within a batch; turns older than ttl against the newest ts are dropped, `most` are kept, and
    an idle session's state goes by processing time. Replays give the same contexts, since only ts decides what lives.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        roles, texts, stamps, last = (list(x) if i < 3 else x for i, x in enumerate(state.get)) if state.exists else ([], [], [], 0)
        held = list(zip(roles, texts, stamps, strict=True))
        rows = pd.concat(list(frames)).sort_values(["seq", "ts"], kind="stable")
        out = []
        for seq, role, text, ts, reset in rows[["seq", "role", "text", "ts", "reset"]].itertuples(index=False):
            last = max(last, int(seq))
            if reset:
                held = []
            elif role in ROLES and text:
                held = [h for h in held if h[2] >= ts - ttl][-(most - 1) :] if most > 1 else []
                held.append((role, " ".join(text.split())[:700], int(ts)))
            out.append((key[0], int(seq), len(held), "\n".join(f"- {r}: {t}" for r, t, _ in held)))
        state.update(([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], last))
        state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame(out, columns=["session_key", "seq", "context_turns", "context"])

    return turns.groupBy("session_key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
