"""Transcript sources: each reader turns raw files or tables into turns (session, pos, role, text, ts), and turns into sessions.

Lines are parsed by Spark's JSON functions with explicit schemas; a bad line is skipped. A reader returns lazily planned
rows; sessions are one aggregation by session id, with the turns in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import safe_session_id
from ..functions.text import short_id

#: Fixed value: characters of a tool's input or output that are shown.
PREVIEW = 240


def lines(spark: SparkSession, path: str, blank: bool = False, exact: bool = False) -> DataFrame:
    """(file, pos, line) of text files in the order of `pos`, with `blank` also the blank lines.

    A file is read in splits, so that many tasks share a large one. Spark gives a line to the split that it begins in, and a split's lines in order:
    `pos` is the split's start plus the bytes of its lines before, which grows from line to line and from split to split. With `exact` it is
    the line's own byte offset; that takes one pass more, as each split then has to know the bytes of all lines before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for b in batches:
            if not len(b):
                continue
            n = pc.add(pc.fill_null(pc.binary_length(b.column("line")), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            file, start = b.column("file").to_numpy(zero_copy_only=False), b.column("start").to_numpy()
            new = np.ones(len(b), bool)
            new[1:] = (start[1:] != start[:-1]) | (file[1:] != file[:-1])
            before = np.cumsum(n) - n
            heads = np.flatnonzero(new)
            base = np.repeat(before[heads], np.diff(np.append(heads, len(b))))
            inside = before - base
            if last == (file[0], start[0]):
                inside[: heads[1] if len(heads) > 1 else len(b)] += done
            last, done = (file[-1], start[-1]), int(inside[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("start"), pa.array(inside), b.column("line")], ["file", "start", "inside", "line"])

    found = rows.mapInArrow(run, "file string, start long, inside long, line string")
    if exact:
        sizes = found.groupBy("file", "start").agg(F.max(F.col("inside") + F.octet_length("line") + 1).alias("size"))  # a row for each split
        before = F.sum("size").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        found = found.join(sizes.select("file", "start", F.coalesce(before, F.lit(0)).alias("before")), ["file", "start"]).withColumn("start", F.col("before"))
    line = F.regexp_replace("line", "\r$", "")
    return found.select("file", (F.col("start") + F.col("inside")).alias("pos"), line.alias("line")).filter(F.lit(blank) | (F.trim(line) != ""))


def bracketed(role: Column, text: Column) -> Column:
    return F.concat(F.lit("["), role, F.lit("] "), text)


def plain(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(": "), text)


def titled(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "User").otherwise("Assistant"), F.lit(": "), text)


def sessions(turns: DataFrame, render: Callable[[Column, Column], Column] = bracketed) -> DataFrame:
    """(session, started_at, ended_at, n_turns, label, body): turns joined by blank lines, labelled by the first user turn."""
    t = F.sort_array(F.collect_list(F.struct("pos", render(F.col("role"), F.col("text")).alias("line"))))
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("pos")))
    return turns.filter("text is not null and trim(text) <> ''").groupBy("session").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("n_turns"), F.substring(first, 1, 80).alias("label"), F.array_join(F.transform(t, lambda x: x["line"]), "\n\n").alias("body"),
    )


#: Tags whose content isn't part of a turn.
ENVELOPES = r"(?s)<(system-reminder|command-name|command-message|command-args|local-command-stdout)[^>]*>.*?</\1>"


def block_jsonl(rows: DataFrame) -> DataFrame:
    """Lines whose message has a text or a list of blocks: text, tool_use and tool_result (previews). Side chains are left out."""
    block = "array<struct<type:string,text:string,name:string,input:string,content:string>>"
    schema = "type string, sessionId string, timestamp string, isSidechain boolean, message struct<role:string,content:string>"
    j = rows.withColumn("j", F.from_json("line", schema)).filter("j.message is not null and coalesce(j.isSidechain, false) = false")
    blocks = F.from_json("j.message.content", block)
    shown = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool "), b["name"], F.lit("] "), F.substring(F.coalesce(b["input"], F.lit("")), 1, PREVIEW))).when(b["type"] == "tool_result", F.concat(F.lit("[result] "), F.substring(F.coalesce(b["content"], F.lit("")), 1, PREVIEW))))
    text = F.when(F.col("j.message.content").startswith("["), F.array_join(F.array_compact(shown), "\n")).otherwise(F.col("j.message.content"))
    return j.select(F.col("j.sessionId").alias("session"), "pos", F.col("j.message.role").alias("role"), F.trim(F.regexp_replace(text, ENVELOPES, "")).alias("text"), F.try_to_timestamp("j.timestamp").alias("ts"))


def agent_sessions(rows: DataFrame) -> DataFrame:
    """(session, parent, root, persona, n_turns, label, body): sessions of block lines (file, pos, line), those of sub-agents included.

    A file in a folder `subagents` whose lines name an agent is that agent's session: its parent is the session that its lines name, its persona
    their slug (`anon` without one), its label says so. Any other file is the session that its first line names, or that its own name does.
    Roots are where parents lead; a parent without a file is a root of its own. Turns are user's and assistant's lines with text.
    """
    from ..operators.graph import resolved

    block = "array<struct<type:string,text:string,name:string,content:string>>"
    schema = "type string, sessionId string, agentId string, slug string, message struct<content:string>"
    j = rows.withColumn("j", F.from_json("line", schema)).select("file", "pos", "j.*")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("pos"))).alias(c)
    head = j.groupBy("file").agg(first("sessionId"), first("agentId"), first("slug"))
    sub = F.col("file").rlike("/subagents/[^/]*$") & F.col("agentId").isNotNull()
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    head = head.select("file", F.when(sub, F.concat(F.lit("sub_"), "agentId")).otherwise(F.coalesce("sessionId", stem)).alias("session"), F.when(sub, F.col("sessionId")).alias("parent"), F.when(sub, F.coalesce("slug", F.lit("anon"))).alias("persona"))
    preview = lambda t: F.concat(F.lit("[tool_result: "), F.substring(t, 1, PREVIEW), F.when(F.length(t) > PREVIEW, "…").otherwise(""), F.lit("]"))
    listed = lambda c: F.coalesce(F.array_join(F.transform(F.from_json(c, "array<struct<text:string>>"), lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), c)
    said = lambda b: F.when(b["content"].startswith("["), listed(b["content"])).otherwise(b["content"])
    shown = F.transform(F.from_json("message.content", block), lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(b["name"], F.lit("tool")), F.lit("]"))).when((b["type"] == "tool_result") & (said(b) != ""), preview(said(b))).when(b["type"] == "image", "[image]"))
    text = F.when(F.col("message.content").startswith("["), F.array_join(F.filter(shown, lambda x: x != ""), "\n")).otherwise(F.col("message.content"))
    text = F.when(F.col("type") == "user", F.trim(F.regexp_replace(text, ENVELOPES, ""))).otherwise(text)
    turns = j.filter(F.col("type").isin("user", "assistant")).select("file", "pos", F.col("type").alias("role"), text.alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    told = sessions(turns.withColumnRenamed("file", "session")).withColumnRenamed("session", "file")
    found = head.join(told.select("file", "n_turns", "label", "body"), "file")
    roots = resolved(head.groupBy("session").agg(F.max("parent").alias("parent")), "session", "parent").select("session", F.col("survivor").alias("root"))
    label = F.coalesce(F.nullif(F.trim(F.get(F.split("label", "\n"), F.lit(0))), F.lit("")), F.lit("Untitled session"))
    label = F.when(F.col("persona").isNull(), label).otherwise(F.concat(F.lit("[subagent "), "persona", F.lit("] "), label))
    return found.join(roots, "session").select("session", "parent", "root", "persona", "n_turns", label.alias("label"), "body")


def event_jsonl(rows: DataFrame) -> DataFrame:
    """Lines with a type and a payload: user and final agent messages, tool calls and outputs as previews; the first
    session_meta of a file names its session."""
    at = lambda p: F.get_json_object("line", f"$.payload.{p}")
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = rows.select("file", "pos", F.get_json_object("line", "$.type").alias("type"), at("type").alias("kind"), at("id").alias("id"), at("message").alias("message"), at("phase").alias("phase"), at("arguments").alias("arguments"), at("output").alias("output"), F.try_to_timestamp(F.get_json_object("line", "$.timestamp")).alias("ts"))
    j = j.withColumn("session", F.first(F.when(F.col("type") == "session_meta", F.col("id")), ignorenulls=True).over(w))
    event, item = F.col("type") == "event_msg", F.col("type") == "response_item"
    said = event & (F.col("kind") == "agent_message") & (F.col("phase").isNull() | (F.col("phase") == "final_answer"))
    role = F.when(event & (F.col("kind") == "user_message"), "user").when(said, "assistant").when(item & F.col("kind").isin("function_call", "function_call_output"), "tool")
    text = F.coalesce("message", F.substring("arguments", 1, PREVIEW), F.substring("output", 1, PREVIEW))
    return j.select("session", "pos", role.alias("role"), text.alias("text"), "ts").filter("role is not null and session is not null")


def custom_jsonl(rows: DataFrame, signal_type: str = "signal") -> tuple[DataFrame, DataFrame]:
    """(turns, signals): message lines, and custom lines of a signal's type with their data."""
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda p: F.get_json_object("line", f"$.{p}")
    j = rows.select("file", "pos", "line", at("type").alias("type"), at("id").alias("id"), F.try_to_timestamp(at("timestamp")).alias("ts"))
    j = j.withColumn("session", F.first(F.when(F.col("type") == "session", F.col("id")), ignorenulls=True).over(w))
    turns = j.filter("type = 'message'").select("session", "pos", at("message.role").alias("role"), at("message.content").alias("text"), "ts")
    signals = j.filter((F.col("type") == "custom") & (at("customType") == signal_type)).select("session", "pos", at("data").alias("detail"), "ts")
    return turns, signals


def custom_sessions(rows: DataFrame) -> DataFrame:
    """(session, aborted, n_turns, label, body) of custom lines (file, pos, line): user's and assistant's messages with text, whose content is a text
    or a list of blocks. A session with a user's turn is aborted if no assistant's turn has text, or every assistant's message ended in an error."""
    at = lambda p: F.get_json_object("line", f"$.{p}")
    j = rows.select("file", "pos", at("type").alias("type"), at("id").alias("id"), at("message.role").alias("role"), at("message.content").alias("content"), at("message.stopReason").alias("stop"), F.coalesce(F.try_to_timestamp(at("message.timestamp")), F.try_to_timestamp(at("timestamp"))).alias("ts"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    head = j.groupBy("file").agg(F.max_by("id", F.when((F.col("type") == "session") & F.col("id").isNotNull(), F.col("pos"))).alias("session")).select("file", F.coalesce("session", stem).alias("session"))
    said = j.filter((F.col("type") == "message") & F.col("role").isin("user", "assistant"))
    blocks = F.transform(F.from_json("content", "array<struct<type:string,text:string>>"), lambda b: F.when(b["type"] == "text", b["text"]))
    text = F.when(F.col("content").startswith("["), F.array_join(F.filter(blocks, lambda x: x != ""), "\n")).otherwise(F.col("content"))
    said = said.withColumn("text", text).join(head, "file")
    worked = F.bool_or((F.col("role") == "assistant") & (F.coalesce("stop", F.lit("")) != "error"))
    spoke = lambda who: F.bool_or((F.col("role") == who) & (F.trim("text") != ""))
    ends = said.groupBy("session").agg((F.coalesce(spoke("user"), F.lit(False)) & ~(F.coalesce(spoke("assistant"), F.lit(False)) & F.coalesce(worked, F.lit(False)))).alias("aborted"))
    return sessions(said.select("session", "pos", "role", "text", "ts")).join(ends, "session").select("session", "aborted", "n_turns", "label", "body")


def message_json(docs: DataFrame) -> DataFrame:
    """Whole JSON documents (file, value) of two shapes: live `messages` beside no request, or a dumped request. A document without a session's id is
    the session that its file is named after; of a session the live document counts, of several the first by file."""
    message = "array<struct<role:string,content:string,timestamp:string>>"
    j = docs.select("file", F.from_json("value", f"session_id string, messages {message}, request struct<body:struct<messages:{message}>>").alias("j"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    j = j.withColumns({"session": F.coalesce(F.nullif("j.session_id", F.lit("")), name), "live": F.col("j.messages").isNotNull() & F.col("j.request").isNull()})
    j = j.withColumn("m", F.when(F.col("live"), F.col("j.messages")).otherwise(F.col("j.request.body.messages"))).filter(F.size("m") > 0)
    one = Window.partitionBy("session").orderBy(F.desc("live"), "file")
    j = j.withColumn("r", F.row_number().over(one)).filter("r = 1")
    t = j.select("session", F.posexplode("m").alias("pos", "m"))
    seconds = F.timestamp_seconds(F.expr("try_cast(m.timestamp AS DOUBLE)"))
    return t.filter("m.role <> 'system'").select("session", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("text"), F.coalesce(seconds, F.try_to_timestamp("m.timestamp")).alias("ts"))


def relational(heads: DataFrame, messages: DataFrame, millis: bool = False) -> DataFrame:
    """Tables of sessions (id, archived) and messages (session_id, role, text, at, ignored), as from JDBC or an export."""
    rows = messages.join(heads.filter(~F.coalesce("archived", F.lit(False))).select(F.col("id").alias("session_id")), "session_id", "left_semi").filter(~F.coalesce("ignored", F.lit(False)))
    ts = F.timestamp_millis("at") if millis else F.timestamp_seconds("at")
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("at", "role", "text"))
    return rows.select(F.col("session_id").alias("session"), pos.alias("pos"), "role", "text", ts.alias("ts"))


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Key-value rows: `composer:<id>` holds turns in line, `bubble:<id>:<n>` one turn each; type 1 is the user, 2 the assistant."""
    bubble = "struct<type:int,text:string,at:long>"
    parts = F.split("key", ":")
    inline = rows.filter("key like 'composer:%'").select(F.get(parts, F.lit(1)).alias("session"), F.posexplode(F.from_json("value", f"turns array<{bubble}>")["turns"]).alias("pos", "b"))
    single = rows.filter("key like 'bubble:%'").select(F.get(parts, F.lit(1)).alias("session"), F.expr("try_cast(split(key, ':')[2] AS INT)").alias("pos"), F.from_json("value", "type int, text string, at long").alias("b"))
    single = single.join(inline.select("session").distinct(), "session", "left_anti")
    role = F.when(F.col("b.type") == 1, "user").when(F.col("b.type") == 2, "assistant")
    return inline.unionByName(single).select("session", "pos", role.alias("role"), F.col("b.text").alias("text"), F.timestamp_millis("b.at").alias("ts")).filter("role is not null")


#: Keys of an editor's workspace table, and what is listed in their values.
COMPOSERS, CHATS = "composer.composerData", "workbench.panel.aichat.view.aichat.chatdata"


def workspace_rows(rows: DataFrame) -> DataFrame:
    """Turns of a workspace's table (key, value): `crw_<id>` of composers that hold their conversation, `crc_<id>` of chat tabs.

    In a composer a turn is the user's by type 1 or role `user`, the assistant's by type 2 or role `assistant`, and others are none; in a tab it
    is the user's by type `user`, else the assistant's, and its raw text counts before its text. A turn has the time that its conversation was made at.
    """
    turn = "array<struct<type:string,role:string,text:string,rawText:string>>"
    when = lambda *c: F.timestamp_millis(F.coalesce(*c))
    c = rows.filter(F.col("key") == COMPOSERS).select(F.explode(F.from_json("value", f"allComposers array<struct<composerId:string,createdAt:long,lastUpdatedAt:long,conversation:{turn}>>")["allComposers"]).alias("c"))
    c = c.select(F.concat(F.lit("crw_"), "c.composerId").alias("session"), F.posexplode("c.conversation").alias("pos", "b"), when("c.createdAt", "c.lastUpdatedAt").alias("ts"))
    user, other = (F.col("b.type") == "1") | (F.col("b.role") == "user"), (F.col("b.type") == "2") | (F.col("b.role") == "assistant")
    c = c.select("session", "pos", F.when(user, "user").when(other, "assistant").alias("role"), F.trim("b.text").alias("text"), "ts").filter("role is not null")
    t = rows.filter(F.col("key") == CHATS).select(F.explode(F.from_json("value", f"tabs array<struct<tabId:string,lastSendTime:long,bubbles:{turn}>>")["tabs"]).alias("c"))
    t = t.select(F.concat(F.lit("crc_"), "c.tabId").alias("session"), F.posexplode("c.bubbles").alias("pos", "b"), when("c.lastSendTime").alias("ts"))
    t = t.select("session", "pos", F.when(F.col("b.type") == "user", "user").otherwise("assistant").alias("role"), F.trim(F.coalesce("b.rawText", "b.text")).alias("text"), "ts")
    return c.union(t).filter("session is not null and text <> ''")


def markdown_log(rows: DataFrame) -> DataFrame:
    """Lines of a chat log, blank ones included: a heading starts a session, `#### ` is a user's turn of one line, and what
    follows up to the next is the assistant's, where lines with `> ` are tool actions. What comes before a user is dropped.

    A session ends where the next one starts, the last one at its own start.
    """
    w = Window.partitionBy("file").orderBy("pos")
    head = F.regexp_extract("line", r"^# .* chat started at (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1)
    r = rows.withColumn("raw", F.when(head != "", head))
    r = r.withColumn("n", F.count("raw").over(w)).filter("n > 0")
    starts = r.filter("raw is not null").select("file", "n", "raw", F.lead("raw").over(w).alias("next"))
    said = r.filter("raw is null").withColumn("chunk", F.count(F.when(F.col("line").startswith("#### "), 1)).over(Window.partitionBy("file", "n").orderBy("pos"))).filter("chunk > 0")
    user = F.col("line").startswith("#### ")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    action = F.concat(F.lit("[tool_action: "), F.substring(F.trim(F.expr("substring(line, 3)")), 1, 200), F.lit("]"))
    shown = F.when(F.col("line").startswith("> "), action).otherwise(F.col("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    turns = said.select("file", "n", "chunk", "pos", F.when(user, "user").otherwise("assistant").alias("role"), F.when(user, F.expr("substring(line, 6)")).otherwise(shown).alias("text"))
    turns = turns.groupBy("file", "n", "chunk", "role").agg(F.min("pos").alias("pos"), trimmed(joined).alias("text")).filter("text <> ''")
    compact = F.concat(F.lit("ai_"), F.replace(F.regexp_replace("raw", "[-:]", ""), F.lit(" "), F.lit("_")))
    time = lambda c: F.try_to_timestamp(F.col(c))
    return turns.join(starts, ["file", "n"]).select("file", compact.alias("session"), "pos", "role", "text", time("raw").alias("ts"), F.coalesce(time("next"), time("raw")).alias("ends_at"))


def generic_jsonl(rows: DataFrame, fields: dict[str, str], default_role: str = "assistant") -> DataFrame:
    """Lines whose field names are configured: content, role, timestamp, session_id."""
    at = lambda k: F.get_json_object("line", f"$.{fields[k]}") if fields.get(k) else F.lit(None).cast("string")
    text = at("content")
    listed = F.from_json(text, "array<struct<text:string>>")
    text = F.when(text.startswith("["), F.coalesce(F.array_join(F.transform(listed, lambda b: b["text"]), "\n"), text)).otherwise(text)
    name = F.coalesce(at("session_id"), F.element_at(F.split("file", "/"), -1))
    return rows.select(safe_session_id(name).alias("session"), "pos", F.coalesce(at("role"), F.lit(default_role)).alias("role"), text.alias("text"), F.try_to_timestamp(at("timestamp")).alias("ts")).filter("text is not null")


def pushed(rows: DataFrame) -> DataFrame:
    """Sessions pushed by a webhook: an id from runtime, start and the first 4000 characters."""
    return rows.withColumn("id", F.concat(F.lit("webhook_"), short_id(F.col("runtime"), F.col("started_at"), F.substring("text", 1, 4000))))


#: Readers by the kind of a source; a webhook pushes and has none.
READERS: dict[str, Callable | None] = {
    "block_jsonl": block_jsonl, "event_jsonl": event_jsonl, "custom_jsonl": custom_jsonl, "message_json": message_json, "relational": relational,
    "keyed_rows": keyed_rows, "workspace_rows": workspace_rows, "markdown_log": markdown_log, "generic_jsonl": generic_jsonl, "webhook": None,
}


def derivables(rows: DataFrame) -> DataFrame:
    """(session, model, tokens, skill): the most frequent model (the later one on ties), all tokens, the first skill."""
    per = rows.filter("model is not null").groupBy("session", "model").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    best = per.groupBy("session").agg(F.max_by("model", F.struct("n", "last")).alias("model"))
    sums = rows.groupBy("session").agg(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).alias("tokens"), F.min_by("skill", F.when(F.col("skill").isNotNull(), F.col("pos"))).alias("skill"))
    return sums.join(best, "session", "left").select("session", "model", "tokens", "skill")


def hunks(diffs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, file, header, added): the hunk of each unified diff with most added lines that aren't blank."""
    rows = diffs.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("file", F.last(F.when(F.col("line").startswith("+++ b/"), F.substring("line", 7, 4096)), ignorenulls=True).over(w))
    rows = rows.withColumn("hunk", F.count(F.when(F.col("line").startswith("@@ "), 1)).over(w)).filter("hunk > 0")
    added = F.col("line").startswith("+") & ~F.col("line").startswith("+++ b/")
    per = rows.groupBy(key, "hunk").agg(F.min_by("file", "pos").alias("file"), F.min_by("line", "pos").alias("header"), F.count_if(added & (F.trim(F.substring("line", 2, 4096)) != "")).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(added, F.struct("pos", F.substring("line", 2, 100_000).alias("t"))))), lambda x: x["t"]), "\n").alias("added"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), "hunk")
    return per.withColumn("r", F.row_number().over(best)).filter("r = 1").select(key, "file", "header", "n", "added")


#: Extension -> language.
LANGUAGES = {"ts": "ts", "tsx": "ts", "js": "js", "jsx": "js", "mjs": "js", "py": "py", "go": "go", "rb": "rb", "rs": "rs", "java": "java", "c": "c", "cpp": "cpp", "cs": "cs", "swift": "swift", "kt": "kt", "sh": "sh", "bash": "sh", "zsh": "sh"}


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1)))
