"""Webhook bodies to message rows, for batch and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import strip, text
from quarry.operators.sessions import reply_target, session_key

_BODY = "events array<struct<type:string,message:struct<type:string,text:string>,source:struct<userId:string,groupId:string,roomId:string>,replyToken:string,timestamp:long>>"


def messages(bodies: DataFrame, body_col: str = "body", scope: str = "user") -> DataFrame:
    """bodies' other columns with event_no, session_key, target, text, reply_token of each text message.

    Other events, blank texts, and messages without a target or session go; a body that doesn't parse has no events.
    """
    rest = [c for c in bodies.columns if c != body_col]
    rows = bodies.select(*rest, F.from_json(body_col, _BODY).alias("_b")).select(*rest, F.posexplode("_b.events").alias("event_no", "e"))
    rows = rows.where("e.type = 'message' and e.message.type = 'text'")
    who = ("e.source.groupId", "e.source.roomId", "e.source.userId")
    rows = rows.select(*rest, "event_no", session_key(*who, scope=scope).alias("session_key"), reply_target(*who).alias("target"), strip(text("e.message.text")).alias("text"), text("e.replyToken").alias("reply_token"))
    return rows.where("text <> '' and session_key <> '' and target <> ''")
