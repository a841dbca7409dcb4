"""Verdicts, and state of the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import sessions as C
from quarry.operators import verdicts as V
from quarry.queries.shared import NAME_ENDS, NAME_MARKS, lit, read, sql_clean_name, sql_collapse, sql_strip
from quarry.sources import tables, webhook

BASE = 1_700_000_000
#: Our own commands and names in the invented corpus.
COMMANDS = [("reset", "(^| )(Thth|Reou|Il|En)"), ("forget", "[?]"), ("recall", "(^| )[Qq]ue( |$)"), ("set_name", "^[A-Z][a-z]{2,5} [a-z]+")]
NAMES = ["^([A-Z][a-zäöüéèñ]{2,12})", "([A-Z][a-zäöüéèñ]+) [a-z]+[.]"]
REJECTED, PREFIXES, PARTS = ["the", "der", "and"], ["th", "ein"], ["ción", "keit"]


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as turns an hour apart; every thirteenth has no time."""
    rows = read(spark, d, "conversations")
    ts = F.when((F.col("conv_id") + F.col("turn")) % 13 != 0, F.lit(BASE) + F.col("turn") * 3600 * 3 + F.col("conv_id"))
    return rows.select(F.col("conv_id").cast("string").alias("session_key"), F.col("turn").alias("seq"), "role", "text", ts.alias("ts"))


def _raw() -> Column:
    """Verdicts of all sorts: none, broken, out of range, repeated, as text."""
    q = F.col("item_id")
    ids = F.concat(F.lit("["), (q % 4).cast("string"), F.lit(", 3, 3, \"2\", \"x\", 99, 1, 4, 5, 6]"))
    return (
        F.when(q % 5 == 0, F.concat(F.lit('So: {"selected_ids": '), ids, F.lit(', "answerable": true, "coverage_gaps": ["dose", " ", "age"]} end')))
        .when(q % 5 == 1, '{"selected_ids": "none", "answerable": "No", "coverage_gaps": "all"}').when(q % 5 == 2, F.concat(F.lit('{"selected_ids": '), ids, F.lit(', "answerable": false}')))
        .when(q % 5 == 3, "not json {").otherwise("")
    )


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").where("item_id % 5 <> 4").select(F.col("item_id").alias("query_id"), _raw().alias("raw"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), (F.col("item_id") % 9).cast("int") + 1)).alias("rank"))


def v1_selected(spark: SparkSession, d: str) -> DataFrame:
    return V.selected(_candidates(spark, d), _verdicts(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


def v1_parsed(spark: SparkSession, d: str) -> DataFrame:
    return V.parsed(_verdicts(spark, d)).select("query_id", F.array_join("ids", ",").alias("ids"), "answerable", "gaps")


def v2_overridden(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_id")
    state = V.parsed(_verdicts(spark, d)).select("query_id", "answerable", (q % 3 == 0).alias("covered_selected"), (q % 2 == 0).alias("covered_all"), (q % 7 < 3).alias("comparison"))
    return V.overridden(state).select("query_id", "answerable", "use_first")


def v3_status(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations")
    n = F.col("conv_id") + F.col("turn")
    review = F.when(n % 3 == 0, F.concat("text", F.lit("\nAnswerable :  NO."))).when(n % 3 == 1, F.concat("text", F.lit(" ANSWERABLE: nothing"))).otherwise(F.col("text"))
    checked = F.when(n % 5 == 0, "verified: no").otherwise("VERIFIED: yes")
    return rows.select("conv_id", "turn", V.final_status(review, checked, n % 7 == 0, n % 2 == 0, n % 11 != 0, n % 13 != 0).alias("status"))


def _who(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("conv_id")
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.when(n % 3 == 0, F.concat(F.lit("g"), (n % 7).cast("string"))).alias("g"), F.when(n % 5 == 0, F.concat(F.lit("r"), (n % 4).cast("string"))).otherwise("").alias("r"), F.when(n % 11 != 0, F.concat(F.lit("u"), n.cast("string"))).alias("u"))


def c1_session_keys(spark: SparkSession, d: str) -> DataFrame:
    return _who(spark, d).select("conv_id", "turn", *[C.session_key("g", "r", "u", s).alias(f"key_{s}") for s in ("user", "chat", "chat_user")], C.reply_target("g", "r", "u").alias("target"))


NOW = BASE + 24 * 3600


def c2_live_context(spark: SparkSession, d: str) -> DataFrame:
    return C.live(turns(spark, d), NOW, most=3).select("session_key", "seq", "role", "ts")


def c3_with_pair(spark: SparkSession, d: str) -> DataFrame:
    pairs = turns(spark, d).select("session_key").distinct().select("session_key", F.concat(F.lit("Question  of "), "session_key").alias("user_text"), F.when(F.col("session_key").cast("long") % 4 == 0, " ").otherwise("answer").alias("assistant_text"), F.lit(NOW).cast("long").alias("ts"))
    return C.with_pair(turns(spark, d), pairs, most=4).select("session_key", "seq", "role", "text", "ts")


def c4_stream_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The turns read as a stream into a table: the live context after each."""
    from quarry.sources.shared import shared_folder
    from quarry.streaming.sessions import session_contexts

    source, out, marks = (shared_folder(spark) for _ in range(3))
    turns(spark, d).where("ts is not null").withColumn("reset", C.command("text", COMMANDS) == "reset").write.parquet(source)
    stream = spark.readStream.schema("session_key string, seq long, role string, text string, ts long, reset boolean").parquet(source)
    query = session_contexts(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(once=True).start()  # with timeouts by processing time, availableNow would go on for ever
    query.awaitTermination()
    return spark.read.parquet(out).select("session_key", "seq", F.col("context_turns").cast("long").alias("context_turns"), "context")


def c5_since_reset(spark: SparkSession, d: str) -> DataFrame:
    return C.since_reset(turns(spark, d), C.command("text", COMMANDS) == "reset").select("session_key", "seq")


def c6_commands(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("session_key", "seq", C.command("text", COMMANDS).alias("command"))


def _name() -> Column:
    return C.display_name("text", NAMES, REJECTED, PREFIXES, PARTS, NAME_ENDS, NAME_MARKS)


def c7_names(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("session_key", "seq", F.coalesce(_name(), F.lit("-")).alias("name"))


def c8_user_memory(spark: SparkSession, d: str) -> DataFrame:
    return C.user_memory(turns(spark, d).select("session_key", "seq", _name().alias("name"), (C.command("text", COMMANDS) == "forget").alias("forget")))


def c9_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return C.transcript(C.live(turns(spark, d), NOW, most=3))


def s4_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table of sessions in Parquet, read back and brought up to date with the later turns."""
    from quarry.sources.shared import shared_folder

    rows = turns(spark, d).groupBy("session_key", F.floor(F.col("seq") / 4).alias("half")).agg(F.max("seq").alias("seq"), F.count("*").alias("n")).cache()
    folder = shared_folder(spark)
    tables.write_table(rows.where("half = 0").drop("half"), None, folder, "overwrite")
    return tables.upserted(tables.read_table(spark, None, folder), rows.where("half > 0").drop("half"), "session_key", "seq").select("session_key", "seq", "n")


def s5_webhook(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with a message, an image, a follow and a blank text per turn."""
    kind = lambda name, text: F.struct(F.lit("message").alias("type"), F.struct(F.lit(name).alias("type"), text.alias("text")).alias("message"), F.struct(F.col("u").alias("userId"), F.col("g").alias("groupId"), F.col("r").alias("roomId")).alias("source"), F.lit("tok").alias("replyToken"))
    follow = F.struct(F.lit("follow").alias("type"), F.struct(F.lit("text").alias("type"), F.lit("x").alias("text")).alias("message"), F.struct(F.col("u").alias("userId"), F.col("g").alias("groupId"), F.col("r").alias("roomId")).alias("source"), F.lit("tok").alias("replyToken"))
    events = F.array(kind("text", F.concat(F.lit(" "), "text", F.lit("\n"))), kind("image", F.lit("no")), follow, kind("text", F.lit("  ")))
    bodies = _who(spark, d).select("conv_id", "turn", F.when(F.col("turn") % 6 == 5, "{broken").otherwise(F.to_json(F.struct(events.alias("events")))).alias("body"))
    return webhook.messages(bodies, scope="chat_user").select("conv_id", "turn", F.col("event_no").cast("long").alias("event_no"), "session_key", "target", "text")


QUERIES = (v1_selected, v1_parsed, v2_overridden, v3_status, c1_session_keys, c2_live_context, c3_with_pair, c4_stream_contexts, c5_since_reset, c6_commands, c7_names, c8_user_memory, c9_transcripts, s4_upsert, s5_webhook)

_TURNS = f"turns as (select cast(conv_id as varchar) as session_key, turn as seq, role, text, case when (conv_id + turn) % 13 <> 0 then {BASE} + turn * 10800 + conv_id end as ts from conversations)"
_COMMAND = "case " + " ".join(f"when regexp_matches(text, {lit(p)}) then '{n}'" for n, p in COMMANDS) + " else 'none' end"


def _name_sql() -> str:
    out = []
    for p in NAMES:
        n = sql_clean_name(f"regexp_extract(text, {lit(p)}, 1)")
        out.append(f"case when {n} <> '' and lower(trim({n})) not in ({', '.join(map(lit, REJECTED))})" + "".join(f" and not starts_with(lower(trim({n})), {lit(x)})" for x in PREFIXES) + "".join(f" and not contains({n}, {lit(x)})" for x in PARTS) + f" then {n} end")
    return f"coalesce({', '.join(out)})"


_WHO = "who as (select conv_id, turn, role, text, case when conv_id % 3 = 0 then 'g' || conv_id % 7 else '' end as g, case when conv_id % 5 = 0 then 'r' || conv_id % 4 else '' end as r, case when conv_id % 11 <> 0 then 'u' || conv_id else '' end as u from conversations), keyed as (select *, coalesce(nullif(g, ''), nullif(r, ''), u) as chat, coalesce(nullif(u, ''), nullif(g, ''), r) as either from who)"
_CHAT_USER = "case when chat <> '' and u <> '' and chat <> u then 'chat_user:' || chat || ':' || u else either end"
_LIVE = f"live as (select * from (select *, row_number() over (partition by session_key order by seq desc) as n from turns where role in ('user', 'assistant') and ts >= {NOW - C.TTL}) where n <= 3)"
_IDS = "(case query_id % 5 when 0 then 1 when 2 then 1 else 0 end) = 1"
_PARSED = f"""parsed as (select item_id as query_id, case when item_id % 5 in (0, 2) then [item_id % 4, 3, 3, 2, 99, 1, 4, 5, 6] else cast([] as bigint[]) end as ids,
    item_id % 5 not in (1, 2) as answerable, case item_id % 5 when 0 then 'dose；age' when 1 then 'all' else '' end as gaps from benchmark where item_id % 5 <> 4)"""

SQL = {
    "v1_parsed": f"with {_PARSED} select query_id, array_to_string(ids, ',') as ids, answerable, gaps from parsed",
    "v1_selected": f"""with {_PARSED}, cand as (select item_id as query_id, unnest(range(1, item_id % 9 + 2)) as rank from benchmark),
        p as (select query_id, unnest(ids) as rank, generate_subscripts(ids, 1) as pos from parsed),
        o as (select query_id, rank, min(pos) as pos from p group by all), j as (select o.* from o join cand using (query_id, rank)),
        k as (select *, row_number() over (partition by query_id order by pos) as place from j)
        select query_id, rank, place from k where place <= 5 union all select query_id, rank, rank from cand where rank <= 5 and query_id not in (select query_id from j)""",
    "v2_overridden": f"with {_PARSED} select query_id, (query_id % 3 = 0 or query_id % 2 = 0) and (answerable or query_id % 7 < 3) as answerable, query_id % 3 <> 0 and query_id % 2 = 0 as use_first from parsed",
    "v3_status": "select conv_id, turn, case when n % 11 = 0 then 'no_hits' when n % 13 = 0 or (n % 3 = 0 and not (n % 7 = 0 and n % 2 = 0)) then 'unanswerable' when n % 5 = 0 and not (n % 7 = 0 and n % 2 = 0) then 'unverified' else 'answered' end as status from (select conv_id, turn, conv_id + turn as n from conversations)",
    "c1_session_keys": f"with {_WHO} select conv_id, turn, either as key_user, case when chat <> '' then 'chat:' || chat else '' end as key_chat, {_CHAT_USER} as key_chat_user, chat as target from keyed",
    "c2_live_context": f"with {_TURNS}, {_LIVE} select session_key, seq, role, ts from live",
    "c3_with_pair": f"""with {_TURNS}, tops as (select session_key, max(seq) as top from turns group by session_key),
        l as (select session_key, seq, role, text, ts from turns where role in ('user', 'assistant') and ts >= {NOW - C.TTL}
          union all select session_key, top + 1, 'user', 'Question  of ' || session_key, {NOW} from tops
          union all select session_key, top + 2, 'assistant', case when cast(session_key as bigint) % 4 = 0 then ' ' else 'answer' end, {NOW} from tops),
        x as (select session_key, seq, role, substr({sql_collapse('text')}, 1, 700) as text, ts from l),
        n as (select *, row_number() over (partition by session_key order by seq desc) as k from x where text <> '')
        select session_key, seq, role, text, ts from n where k <= 4""",
    "c4_stream_contexts": f"""with {_TURNS}, t as (select *, {_COMMAND} = 'reset' as reset from turns where ts is not null),
        g as (select a.session_key, a.seq, a.role, a.ts, a.text, a.reset, coalesce((select max(b.seq) from t b where b.session_key = a.session_key and b.reset and b.seq <= a.seq), -1) as cut,
              (select max(b.seq) from t b where b.session_key = a.session_key and b.seq <= a.seq and not b.reset and b.role in ('user', 'assistant') and b.text <> '') as seen from t a),
        c as (select g.session_key, g.seq, b.seq as bseq, b.role, substr({sql_collapse('b.text')}, 1, 700) as text from g join t s on s.session_key = g.session_key and s.seq = g.seen
              join t b on b.session_key = g.session_key and b.seq <= g.seen and b.seq > g.cut and not b.reset and b.role in ('user', 'assistant') and b.text <> '' and b.ts >= s.ts - {C.TTL}),
        k as (select *, row_number() over (partition by session_key, seq order by bseq desc) as n from c)
        select t.session_key, t.seq, count(k.bseq) as context_turns, coalesce(string_agg('- ' || k.role || ': ' || k.text, chr(10) order by k.bseq), '') as context
        from t left join k on k.session_key = t.session_key and k.seq = t.seq and k.n <= {C.MESSAGES} group by t.session_key, t.seq""",
    "c5_since_reset": f"with {_TURNS} select session_key, seq from turns t where not exists (select 1 from turns r where r.session_key = t.session_key and r.seq >= t.seq and (select {_COMMAND} from (select r.text as text)) = 'reset')",
    "c6_commands": f"with {_TURNS} select session_key, seq, {_COMMAND} as command from turns",
    "c7_names": f"with {_TURNS} select session_key, seq, coalesce({_name_sql()}, '-') as name from turns",
    "c8_user_memory": f"""with {_TURNS}, n as (select session_key, seq, {_name_sql()} as name, {_COMMAND} = 'forget' as forget from turns),
        m as (select session_key, arg_max(name, seq) filter (name is not null) as display_name, max(seq) filter (name is not null) as named, max(seq) filter (forget) as forgot from n group by session_key)
        select session_key, display_name from m where named is not null and (forgot is null or forgot < named)""",
    "c9_transcripts": f"with {_TURNS}, {_LIVE} select session_key, string_agg('- ' || case role when 'user' then 'User' else 'Assistant' end || ': ' || substr({sql_collapse('text')}, 1, 700), chr(10) order by seq) as transcript from live where {sql_collapse('text')} <> '' group by session_key",
    "s4_upsert": "select session_key, seq, n from (select *, row_number() over (partition by session_key order by seq desc) as k from (select cast(conv_id as varchar) as session_key, turn // 4 as half, max(turn) as seq, count(*) as n from conversations group by all)) where k = 1",
    "s5_webhook": f"with {_WHO} select conv_id, turn, cast(0 as bigint) as event_no, {_CHAT_USER} as session_key, chat as target, {sql_strip('text')} as text from keyed where turn % 6 <> 5 and {sql_strip('text')} <> '' and chat <> '' and ({_CHAT_USER}) <> ''",
}
