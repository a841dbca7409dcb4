"""Conversation state in batch: session keys, live context, commands, names, transcripts.

Turns are rows (session_key, seq, role, text, ts); ts in seconds, null counts as long past. Nothing groups a session
beyond its last turns: windows keep at most `most` rows per session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

MESSAGES, TTL = 8, 43_200
ROLES = ("user", "assistant")


def _filled(c: Column | str) -> Column:
    return F.nullif(T.text(c), F.lit(""))


def reply_target(group: Column | str, room: Column | str, user: Column | str) -> Column:
    return F.coalesce(_filled(group), _filled(room), _filled(user), F.lit(""))


def session_key(group: Column | str, room: Column | str, user: Column | str, scope: str = "user") -> Column:
    """scope: `user`, `chat`, or `chat_user`."""
    chat, own = reply_target(group, room, user), F.coalesce(_filled(user), F.lit(""))
    either = F.coalesce(_filled(user), chat)
    if scope == "chat":
        return F.when(chat != "", F.concat(F.lit("chat:"), chat)).otherwise("")
    if scope == "chat_user":
        return F.when((chat != "") & (own != "") & (chat != own), F.concat(F.lit("chat_user:"), chat, F.lit(":"), own)).otherwise(either)
    return either


def live(turns: DataFrame, now: int | Column, ttl: int = TTL, most: int = MESSAGES) -> DataFrame:
    """The last `most` turns of each session that are no older than ttl and were said by a user or an assistant."""
    now = F.lit(now) if isinstance(now, int) else now
    rows = turns.where(F.col("role").isin(*ROLES) & (F.col("ts") >= now - ttl))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_key").orderBy(F.col("seq").desc()))).where(F.col("_n") <= most).drop("_n")


def with_pair(turns: DataFrame, pairs: DataFrame, ttl: int = TTL, most: int = MESSAGES) -> DataFrame:
    """The context of each session that has a new pair (session_key, user_text, assistant_text, ts), after it.

    Live turns, then the pair with the same ts; empty texts go, and the last `most` stay.
    """
    last = turns.join(pairs.select("session_key", F.col("ts").alias("now")), "session_key")
    kept = live(last, F.col("now"), ttl, 1 << 30).select("session_key", "seq", "role", "text", "ts")
    top = turns.groupBy("session_key").agg(F.max("seq").alias("top"))
    both = F.array(F.struct(F.lit(1).alias("k"), F.lit("user").alias("role"), F.col("user_text").alias("text")), F.struct(F.lit(2).alias("k"), F.lit("assistant").alias("role"), F.col("assistant_text").alias("text")))
    new = pairs.join(top, "session_key", "left").select("session_key", "ts", F.coalesce("top", F.lit(0)).alias("top"), F.explode(both).alias("p"))
    new = new.select("session_key", (F.col("top") + F.col("p.k")).alias("seq"), "p.role", "p.text", "ts")
    rows = kept.unionByName(new).withColumn("text", T.context_text("text")).where("text <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("session_key").orderBy(F.col("seq").desc()))).where(F.col("_n") <= most).drop("_n")


def since_reset(turns: DataFrame, reset: Column) -> DataFrame:
    """Turns after the session's last reset command; the command itself isn't kept."""
    last = F.max(F.when(reset, F.col("seq"))).over(Window.partitionBy("session_key"))
    return turns.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).drop("_last")


def command(text: Column | str, patterns: list[tuple[str, str]], default: str = "none") -> Column:
    """The name of the first pattern that matches."""
    return F.coalesce(*[F.when(T.text(text).rlike(p), F.lit(name)) for name, p in patterns], F.lit(default))


def plausible_name(name: Column, rejected: list[str], prefixes: list[str], parts: list[str]) -> Column:
    low = F.lower(F.trim(name))
    out = (name != "") & ~low.isin(*rejected)
    for p in prefixes:
        out = out & ~low.startswith(p)
    for p in parts:
        out = out & ~name.contains(p)
    return out


def display_name(text: Column | str, patterns: list[str], rejected: list[str], prefixes: list[str], parts: list[str], ends: Sequence[str] = (), marks: Sequence[str] = ()) -> Column:
    """The first pattern's capture that is a plausible name once cleaned, else null. ends, marks: see clean_name()."""
    names = [T.clean_name(F.regexp_extract(T.text(text), p, 1), ends, marks) for p in patterns]
    return F.coalesce(*[F.when(plausible_name(n, rejected, prefixes, parts), n) for n in names])


def user_memory(commands: DataFrame) -> DataFrame:
    """(session_key, display_name) after commands (session_key, seq, name, forget): the last name, unless forgotten since."""
    last = commands.groupBy("session_key").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("display_name"), F.max(F.when(F.col("name").isNotNull(), F.col("seq"))).alias("named"), F.max(F.when(F.col("forget"), F.col("seq"))).alias("forgot"))
    return last.where(F.col("named").isNotNull() & (F.col("forgot").isNull() | (F.col("forgot") < F.col("named")))).select("session_key", "display_name")


def transcript(turns: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(session_key, transcript): a line per turn, in order."""
    labels = labels or {"user": "User", "assistant": "Assistant"}
    who = F.coalesce(*[F.when(F.col("role") == k, F.lit(v)) for k, v in labels.items()], F.lit("Message"))
    line = F.concat(F.lit("- "), who, F.lit(": "), T.context_text("text"))
    rows = turns.where(T.context_text("text") != "").groupBy("session_key").agg(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return rows.select("session_key", F.array_join("l.line", "\n").alias("transcript"))
