"""Queries over scalar transforms and sources: F9-F33, S8-S17."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.hashes import fnv_12
from ..functions.injected import strip_blocks
from ..functions.text import chunks, folded, label_key, repo_base, short_id
from ..operators.recall import holding
from ..operators.tables import shared_dir
from ..operators.telemetry import citations, misses
from ..sources import transcripts as t
from .registry import Views, query


#: Prompts that the conversations don't have; they are turns of conversation -1.
PROMPTS = [
    "what depends on the parser", "when did we change the port", "look at Ada and the API", "two weeks ago we met", "", "fix it before I leave", "Which tool uses Kafka?", "ok", "please write a note",
    "open the door on monday", "the I'd rather", "see README now", "why does the build fail on Linux machines", "<system-reminder>no query here at all</system-reminder>", "<system-reminders> unrelated words here",
    "Hey, could you please draft a plan", "<command-name>x</command-name> write me a poem", "<ide_selection>nothing closes this", "please, ok", "let's invent something", "  <output-file>some\nlines</output-file>", "3 days ago", "what uses Kafka",
]
ASKED = "p0 AS (SELECT conv_id, turn::BIGINT AS turn, text AS q FROM conversations UNION ALL SELECT -1, i, q FROM (VALUES " + ", ".join(f"({i}, '" + p.replace("'", "''") + "')" for i, p in enumerate(PROMPTS)) + ") AS t(i, q))"


def _prompts(v: Views) -> DataFrame:
    made = v.spark.createDataFrame(list(enumerate(PROMPTS)), "turn long, q string").select(F.lit(-1).cast("long").alias("conv_id"), "turn", "q")
    return v.conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").alias("q")).union(made)


def _prompt_sql() -> str:
    text, rest = "q", "p"
    for tag in rules.TAGS:
        text = f"regexp_replace({text}, '(?is)<{tag}\\b[^>]*>.*?(</{tag}>|$)', ' ', 'g')"
    for _ in range(3):
        rest = f"regexp_replace({rest}, '(?i)^(" + rules.FILLER.replace("'", "''") + ")\\b[\\s,]*', '')"
    return f"""WITH {ASKED}, p1 AS (SELECT conv_id, turn, trim(regexp_replace({text}, '\\s+', ' ', 'g')) AS p FROM p0), p2 AS (SELECT *, trim({rest}) AS rest FROM p1)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(p, '[A-Za-z0-9]{{2,}}') OR regexp_matches(p, '(?i)^({rules.ACKNOWLEDGED})\\W*$') OR NOT regexp_matches(rest, '[A-Za-z0-9]{{2,}}') THEN 'skip'
 WHEN regexp_matches(rest, '(?i)^({rules.GENERATIVE})\\b') THEN 'generative' ELSE 'evaluate' END AS class FROM p2"""


@query(_prompt_sql())
def f9_prompt_class(v: Views) -> DataFrame:
    return _prompts(v).select("conv_id", "turn", rules.prompt_class(F.col("q")).alias("class"))


TEMPORAL = r"(regexp_matches(q, '(?i)\b(" + "|".join(rules.TEMPORAL) + r")\b') OR regexp_matches(q, '\b(before|after)\s+I\b'))"


@query(rf"WITH {ASKED} SELECT conv_id, turn, CASE WHEN trim(q) = '' THEN 'other' WHEN regexp_matches(q, '(?i)\b(" + "|".join(rules.RELATIONAL) + rf")\b') THEN 'relational' WHEN {TEMPORAL} THEN 'temporal' ELSE 'lookup' END AS intent FROM p0")
def f10_query_intent(v: Views) -> DataFrame:
    return _prompts(v).select("conv_id", "turn", rules.query_intent(F.col("q")).alias("intent"))


NAMED = "len(list_filter(list_filter(regexp_split_to_array(q, '[\\s,.;:!?()\"''`]+'), lambda x: x <> '')[2:], lambda x: length(x) >= 2 AND lower(x) NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in rules.NOT_NAMES) + ") AND (regexp_matches(x, '^[A-Z]{2,}$') OR regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]')))) > 0"


@query(f"WITH {ASKED} SELECT conv_id, turn, {TEMPORAL} AS temporal, {NAMED} AS named FROM p0")
def f11_query_shape(v: Views) -> DataFrame:
    return _prompts(v).select("conv_id", "turn", rules.has_temporal(F.col("q")).alias("temporal"), rules.has_name(F.col("q")).alias("named"))


@query(f"""WITH {ASKED}, w AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(q), '\\s+'), lambda x: regexp_replace(x, '^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$', '', 'g')), lambda x: length(x) >= 3 AND lower(x) NOT IN ({", ".join(f"'{w}'" for w in rules.STOP)})) AS w FROM p0)
SELECT conv_id, turn, CASE WHEN len(w) >= 2 AND NOT regexp_matches(q, '^\\s*<({"|".join(rules.HARNESS)})\\b') THEN array_to_string(w, ' ') END AS q FROM w""")
def f12_recall_query(v: Views) -> DataFrame:
    return _prompts(v).select("conv_id", "turn", rules.recall_query(F.col("q")).alias("q"))


@query("SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{2,}'), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in rules.NO_TOPIC) + "))) AS n FROM conversations")
def f13_topical_words(v: Views) -> DataFrame:
    return v.conversations.select("conv_id", "turn", rules.topical_words(F.col("text")).cast("long").alias("n"))


@query(r"""WITH h AS (SELECT doc_id, text, substr(text, 1, 200) AS h FROM documents), m AS (SELECT *, CASE WHEN right(h, 1) IN ('.', '!', '?') THEN h ELSE regexp_extract(h, '(?s)^(.{60,}[.!?]) ', 1) END AS a, regexp_extract(h, '(?s)^(.{60,}) ', 1) AS b FROM h)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN a <> '' THEN a WHEN b <> '' THEN b || ' ...' ELSE h || ' ...' END AS summary FROM m""")
def f15_summary(v: Views) -> DataFrame:
    return v.documents.select("doc_id", rules.short_summary(F.col("text")).alias("summary"))


@query(r"""WITH t AS (SELECT conv_id, turn, 'intro' || repeat(chr(10), 5) || text AS t FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '\n([ \t]*\n){2,}', chr(10) || chr(10), 'g'), '^([ \t]*\n)+', ''), '(\n[ \t]*)+$', '') AS text FROM t""")
def f16_strip_injected(v: Views) -> DataFrame:
    made = F.concat(F.lit("intro\n\n## Known\n- a\nTools: x, y\n\n\n\n"), "text")
    return v.conversations.select("conv_id", "turn", strip_blocks(made, ["## Known"]).alias("text"))


@query("SELECT id, CASE WHEN status IN ('superseded', 'replaced') THEN status WHEN seq % 2000 < 15 THEN 'active' WHEN seq % 2000 < 1440 THEN 'idle' ELSE 'closed' END AS live FROM sessions")
def f17_live_status(v: Views) -> DataFrame:
    return v.sessions.select("id", rules.live_status(F.col("status"), F.col("seq") % 2000).alias("live"))


@query("""WITH p AS (SELECT doc_id, trim(label) AS h, trim(body) AS b FROM papers), q AS (SELECT *, CASE WHEN h <> '' THEN h || ' ' ELSE '' END AS pre FROM p), r AS (SELECT *, greatest(1, 1000 - length(pre)) AS bud FROM q),
s AS (SELECT doc_id, CASE WHEN b = '' THEN [h] WHEN length(b) <= bud THEN [trim(pre || b)] ELSE [trim(pre || substr(b, 1, bud))] || list_filter(list_transform(range(0, greatest(0, ceil((length(b) - greatest(0, bud - 100) - 1000) / 900))::BIGINT + 1), lambda k: trim(substr(b, greatest(0, bud - 100) + k * 900 + 1, 1000))), lambda x: x <> '') END AS c FROM r)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, '|')) AS digest FROM s""")
def f18_chunks(v: Views) -> DataFrame:
    pieces = chunks(F.col("label"), F.col("body"), 1000, 100)
    return v.papers.select("doc_id", pieces.alias("c")).select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN seq * 1000000 ELSE seq * 100 END AS x, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN CASE WHEN seq * 1000000 > 10000000000 THEN seq * 1000000 ELSE seq * 1000000000 END ELSE seq * 100000 END AS ms FROM sessions")
def f19_timestamps(v: Views) -> DataFrame:
    k = F.col("seq")
    x = F.when(k % 3 == 1, k * 1000000).when(k % 3 == 2, k * 100)
    return v.sessions.select("seq", x.alias("x"), rules.as_millis(x).alias("ms"))


@query("SELECT seq, CASE seq % 5 WHEN 0 THEN 'as ' || seq WHEN 1 THEN '' WHEN 2 THEN '' ELSE strftime(make_timestamp(CASE WHEN seq % 5 = 3 THEN seq * 1000000 ELSE (seq + 10000000001) * 1000 END), '%Y-%m-%dT%H:%M:%S.%gZ') END AS t FROM sessions WHERE seq > 0")
def f19_timestamp_texts(v: Views) -> DataFrame:
    """Texts pass through; numbers are seconds or milliseconds; 0 and nothing are empty."""
    k = F.col("seq") % 5
    text = F.when(k == 0, F.concat(F.lit("as "), F.col("seq").cast("string"))).when(k == 1, "")
    number = F.when(k == 2, 0).when(k == 3, F.col("seq")).when(k == 4, F.col("seq") + 10_000_000_001)
    return v.sessions.filter("seq > 0").select("seq", rules.timestamp_text(text, number).alias("t"))


@query("SELECT id, CASE WHEN seq % 3 = 0 THEN 'a_' || id || '_x_y' WHEN seq % 3 = 1 THEN 'a_' || id ELSE id END AS raw, CASE WHEN seq % 3 = 0 THEN 'a_' || id || '_y' WHEN seq % 3 = 1 THEN 'a_' || id ELSE id END AS safe FROM sessions")
def f20_safe_ids(v: Views) -> DataFrame:
    k = F.col("seq") % 3
    raw = F.when(k == 0, F.concat(F.lit("a_"), "id", F.lit("_x_y"))).when(k == 1, F.concat(F.lit("a_"), "id")).otherwise(F.col("id"))
    return v.sessions.select("id", raw.alias("raw")).select("id", "raw", rules.safe_session_id(F.col("raw")).alias("safe"))


@query("SELECT id, coalesce(greatest(0, (epoch_us(ended_at) - epoch_us(started_at)) // 60000000), 0) AS minutes FROM sessions")
def f21_duration(v: Views) -> DataFrame:
    return v.sessions.select("id", rules.duration_minutes(F.col("started_at"), F.col("ended_at")).alias("minutes"))


@query(r"SELECT p_partkey, regexp_replace(lower(trim('  ' || p_name || '  X ')), '\s+', ' ', 'g') AS label, regexp_replace(lower(p_name), '[\s\-_.]+', '', 'g') AS fold, regexp_replace(regexp_replace(lower(p_name || '.py'), '[\s\-_.]+', '', 'g'), '(ts|js|py|rs|go)$', '') AS base FROM part")
def f22_names(v: Views) -> DataFrame:
    """F22, F23."""
    name = F.col("p_name")
    return v.part.select("p_partkey", label_key(F.concat(F.lit("  "), name, F.lit("  X "))).alias("label"), folded(name).alias("fold"), repo_base(folded(F.concat(name, F.lit(".py")))).alias("base"))


PREFIXES = [("https://m", "mobile"), ("https://m.thed", "mobile-d"), ("http://www", "global"), ("http://www", "web"), ("https", "any")]


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PREFIXES) + ") AS t(prefix, scope)) SELECT page_id, scope FROM pages JOIN p ON starts_with(url, prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC, scope = 'global', scope) = 1")
def f24_scopes(v: Views) -> DataFrame:
    """Longest prefix; named scopes before the global one, then by name."""
    table = v.spark.createDataFrame(PREFIXES, "prefix string, scope string")
    hits = v.pages.select("page_id", "url").join(F.broadcast(table), F.col("url").startswith(F.col("prefix")))  # a small fixed table
    w = Window.partitionBy("page_id").orderBy(F.desc(F.length("prefix")), F.col("scope") == "global", "scope")
    return hits.withColumn("r", F.row_number().over(w)).filter("r = 1").select("page_id", "scope")


@query("SELECT event_id, 'sig_' || substr(sha256(coalesce(session_id, '') || '|' || producer || '|' || kind || '|' || coalesce(step, '') || '|' || outcome), 1, 16) AS id FROM signals")
def f25_signal_ids(v: Views) -> DataFrame:
    return v.signals.select("event_id", F.concat(F.lit("sig_"), short_id(F.col("session_id"), F.col("producer"), F.col("kind"), F.col("step"), F.col("outcome"))).alias("id"))


@query("""SELECT conv_id, turn, substr(printf('%016x', list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(text, ''), lambda c: unicode(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 1, 12) AS hash FROM conversations""")
def f25_fnv_ids(v: Views) -> DataFrame:
    return v.conversations.select("conv_id", "turn", fnv_12(F.col("text")).alias("hash"))


@query("""SELECT event_id, CASE WHEN kind = 'test' THEN NULL ELSE kind END AS kind, coalesce(step, 'unknown') AS step, json_extract_string(props, '$.k') AS k, kind <> 'test' AND outcome <> 'exhausted' AS valid FROM signals JOIN (SELECT event_id, props FROM events) USING (event_id)""")
def f26_signal_checks(v: Views) -> DataFrame:
    rows = v.signals.join(v.events.select("event_id", "props"), "event_id")
    ok = F.col("kind").isin("gate", "eval", "review") & F.col("outcome").isin("pass", "fail", "fix")
    return rows.select("event_id", F.when(F.col("kind") != "test", F.col("kind")).alias("kind"), F.coalesce("step", F.lit("unknown")).alias("step"), F.get_json_object("props", "$.k").alias("k"), ok.alias("valid"))


@query(r"SELECT doc_id, sha256(regexp_replace(trim(text), '[ \t\n\r]+', ' ', 'g')) AS code_hash, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) BETWEEN 2 AND 200 AS fit FROM documents")
def f27_exemplars(v: Views) -> DataFrame:
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return v.documents.select("doc_id", F.sha2(F.regexp_replace(F.trim("text"), r"[ \t\n\r]+", " "), 256).alias("code_hash"), n.between(2, 200).alias("fit"))


@query(r"""WITH l AS (SELECT conv_id, turn, text, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM conversations)
SELECT conv_id || '.' || turn AS diff, CASE WHEN n >= 2 THEN 'src/b.py' ELSE 'src/a.ts' END AS file, CASE WHEN n >= 2 THEN '@@ -5 +5 @@ def' ELSE '@@ -1 +1 @@' END AS header, greatest(n, 1) AS n, CASE WHEN n >= 2 THEN text ELSE 'one' END AS added, CASE WHEN n >= 2 THEN 'py' ELSE 'ts' END AS lang FROM l""")
def f28_diff_hunks(v: Views) -> DataFrame:
    """Each turn's lines are one file's added lines; those of a single line lose to the first hunk, which comes first."""
    added = F.concat(F.lit("+"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n+")))
    diff = F.concat(F.lit("+++ b/src/a.ts\n@@ -1 +1 @@\n+one\n-two\n+++ b/src/b.py\n@@ -5 +5 @@ def\n"), added, F.lit("\n context"))
    rows = v.conversations.select(F.concat_ws(".", "conv_id", "turn").alias("id"), diff.alias("diff"))
    return t.hunks(rows, "id", "diff").select(F.col("id").alias("diff"), "file", "header", F.col("n").cast("int").alias("n"), "added", t.language_of(F.col("file")).alias("lang"))


@query("""WITH r AS (SELECT user_id, event_type, event_id FROM events), m AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS l FROM r GROUP BY 1, 2)
SELECT user_id AS session, (SELECT arg_max(event_type, (n, l)) FROM m WHERE m.user_id = u.user_id) AS model, sum(event_id % 7 + event_id % 5)::BIGINT AS tokens, arg_min(event_type, event_id) FILTER (event_type IN ('view', 'click')) AS skill FROM events u GROUP BY user_id""")
def f29_derivables(v: Views) -> DataFrame:
    rows = v.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("model"), (F.col("event_id") % 7).alias("input_tokens"), (F.col("event_id") % 5).alias("output_tokens"), F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).alias("skill"))
    return t.derivables(rows)


@query("SELECT id, regexp_extract('agent-' || workstream_id || '@' || id, '^agent-([^@]+)@(.+)$', 1) AS persona, regexp_extract('agent-' || workstream_id || '@' || id, '^agent-([^@]+)@(.+)$', 2) AS parent FROM sessions")
def f30_personas(v: Views) -> DataFrame:
    name = F.concat(F.lit("agent-"), "workstream_id", F.lit("@"), "id")
    return v.sessions.select("id", F.regexp_extract(name, "^agent-([^@]+)@(.+)$", 1).alias("persona"), F.regexp_extract(name, "^agent-([^@]+)@(.+)$", 2).alias("parent"))


@query("SELECT id, subject || ' ' || predicate || ' ' || value AS text FROM facts")
def f31_fact_texts(v: Views) -> DataFrame:
    return v.facts.select("id", F.concat_ws(" ", "subject", "predicate", "value").alias("text"))


# Conversations play answers: of each, the users' turns are tool calls and the others prose; surfaced are its first five
# words of six letters or more, a word of three, and one that nobody says. Calls by the first turn ask for an id outright.
CITING = """w AS (SELECT conv_id, turn, role, text, string_split(text, ' ') AS w FROM conversations),
s AS (SELECT DISTINCT conv_id, unnest(list_filter(w, lambda x: length(x) >= 6)[1:5] || ['the', 'nobody-says-it']) AS id FROM w WHERE turn = 0),
h AS (SELECT s.conv_id, s.id, min(CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS kind FROM s JOIN w ON w.conv_id = s.conv_id AND contains(w.text, s.id) WHERE length(s.id) >= 6 GROUP BY 1, 2)"""


def _citing(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    words = F.split("text", " ")
    ids = F.concat(F.slice(F.filter(words, lambda x: F.length(x) >= 6), 1, 5), F.array(F.lit("the"), F.lit("nobody-says-it")))
    surfaced = v.conversations.filter("turn = 0").select("conv_id", F.explode(ids).alias("id"))
    calls = v.conversations.filter("role = 'user'").select("conv_id", F.lit("mcp__memory__recall").alias("name"), F.col("text").alias("input"))
    prose = v.conversations.filter("role <> 'user'").select("conv_id", "text")
    return surfaced, calls, prose


@query("WITH " + CITING + " SELECT conv_id, id, CASE WHEN kind = 0 THEN 'tool_use' ELSE 'prose' END AS kind FROM h")
def f32_citations(v: Views) -> DataFrame:
    """Which surfaced ids an answer cites, by a tool call or else in prose."""
    surfaced, calls, prose = _citing(v)
    return citations(surfaced, calls, prose, "conv_id")


@query("SELECT conv_id, id, CASE WHEN min(turn) % 2 = 0 THEN 'get_session' ELSE 'cite_session' END AS kind FROM (SELECT conv_id, turn, string_split(text, ' ')[1] AS id FROM conversations) c WHERE length(id) >= 6 AND NOT EXISTS (SELECT 1 FROM (" + "WITH " + CITING + " SELECT * FROM s) s WHERE s.conv_id = c.conv_id AND s.id = c.id) GROUP BY 1, 2")
def f32_misses(v: Views) -> DataFrame:
    """Ids that a call asks for although they weren't surfaced."""
    surfaced, _, _ = _citing(v)
    name = F.concat(F.lit("mcp__memory__"), F.when(F.col("turn") % 2 == 0, "get_session").otherwise("cite_session"))
    calls = v.conversations.select("conv_id", "turn", name.alias("name"), F.to_json(F.struct(F.get(F.split("text", " "), F.lit(0)).alias("id"))).alias("input"))
    return misses(surfaced, calls, "conv_id", "turn")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def f32_passages(v: Views) -> DataFrame:
    """Which documents hold which passages."""
    return holding(v.documents, v.benchmark, "doc_id", "item_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x IS NULL OR isnan(x) OR x < 1 THEN 1 WHEN x > 100 THEN 100 ELSE floor(x)::INT END AS clamped FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE (l_quantity - 3) * l_linenumber END AS x FROM lineitem)")
def f33_limits(v: Views) -> DataFrame:
    from ..operators.access import clamped

    n = F.col("l_linenumber")
    x = F.when(n == 1, F.lit(None)).when(n == 2, F.lit(float("nan"))).otherwise((F.col("l_quantity") - 3) * n)
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", clamped(x.cast("double")).alias("clamped"))


BODY = "SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n_turns, md5(string_agg({}, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY 1"


def _json_lines(v: Views, **fields: object) -> DataFrame:
    """Lines as a source would have them, made of the driver's conversations."""
    made = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    return v.conversations.select(F.concat(F.lit("/x/"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("pos"), made.alias("line"))


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select("session", "n_turns", F.md5("body").alias("digest"))



def _name():
    return F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_z"))


@query(BODY.format("'[' || role || '] ' || trim(text)"))
def s8_block_jsonl(v: Views) -> DataFrame:
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    rows = _json_lines(v, type=F.col("role"), sessionId=_name(), message=F.struct(F.col("role"), block.alias("content")))
    return _digested(t.sessions(t.block_jsonl(rows)))


@query("""WITH c AS (SELECT *, conv_id % 4 = 1 AS sub FROM conversations), h AS (SELECT conv_id, any_value(sub) AS sub FROM c GROUP BY 1)
SELECT CASE WHEN sub THEN 'sub_a' || c.conv_id ELSE 'conv_' || c.conv_id || '_z' END AS session, CASE WHEN sub THEN 'conv_' || (c.conv_id - 1) || '_z' END AS parent,
CASE WHEN sub THEN 'conv_' || (c.conv_id - 1) || '_z' ELSE 'conv_' || c.conv_id || '_z' END AS root, CASE WHEN sub THEN CASE WHEN c.conv_id % 3 = 0 THEN 'anon' ELSE 'scout' END END AS persona,
count(*) AS n_turns, md5(string_agg('[' || role || '] ' || CASE WHEN role = 'user' THEN trim(text) ELSE text || chr(10) || '[tool_use: grep]' || chr(10) || '[tool_result: ' || substr(text, 1, 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END || ']' END, chr(10) || chr(10) ORDER BY turn)) AS digest
FROM c WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY c.conv_id, sub""")
def s8_subagents(v: Views) -> DataFrame:
    """Every fourth conversation is a sub-agent's file in the folder of the one before."""
    k, text = F.col("conv_id"), F.lit("text").alias("type")
    sub, name = k % 4 == 1, lambda n: F.concat(F.lit("conv_"), n.cast("string"), F.lit("_z"))
    none = F.lit(None).cast("string")
    block = lambda kind, t=none, name=none, content=none: F.struct(F.lit(kind).alias("type"), t.alias("text"), name.alias("name"), content.alias("content"))
    tools = F.to_json(F.array(block("text", F.col("text")), block("tool_use", name=F.lit("grep")), block("tool_result", content=F.col("text"))))
    content = F.when(F.col("role") == "user", F.to_json(F.array(F.struct(text, F.col("text").alias("text"))))).otherwise(tools)
    line = F.to_json(F.struct(F.col("role").alias("type"), name(F.when(sub, k - 1).otherwise(k)).alias("sessionId"), F.when(sub, F.concat(F.lit("a"), k.cast("string"))).alias("agentId"), F.when(k % 3 != 0, "scout").alias("slug"), F.struct(content.alias("content")).alias("message")))
    file = F.when(sub, F.concat(F.lit("/x/"), (k - 1).cast("string"), F.lit("/subagents/"), k.cast("string"), F.lit(".jsonl"))).otherwise(F.concat(F.lit("/x/"), k.cast("string"), F.lit(".jsonl")))
    found = t.agent_sessions(v.conversations.filter("trim(text) <> ''").select(file.alias("file"), F.col("turn").alias("pos"), line.alias("line")))
    return found.select("session", "parent", "root", "persona", "n_turns", F.md5("body").alias("digest"))


@query("SELECT 'conversations/' || (conv_id % 3) AS file, count(*) AS n, count(DISTINCT conv_id) AS sessions, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY 1")
def s7_split_lines(v: Views) -> DataFrame:
    """Conversations as three files of lines, read in splits: each line once, and offsets that are those of the bytes before."""
    import uuid

    at = f"{shared_dir(v.spark)}/lines-{uuid.uuid4().hex}"
    rows = v.conversations.select((F.col("conv_id") % 3).alias("p"), F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    rows.repartition("p").write.partitionBy("p").text(at)
    found = t.lines(v.spark, at, exact=True).withColumn("j", F.from_json("line", "conv_id long, turn long, text string"))
    w = Window.partitionBy("file").orderBy("pos")
    found = found.withColumn("after", F.coalesce(F.lag(F.col("pos") + F.octet_length("line") + 1).over(w), F.lit(0))).filter("pos = after")
    name = F.concat(F.lit("conversations/"), F.regexp_extract("file", "p=([0-9]+)", 1))
    return found.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("j.conv_id").alias("sessions"), F.sum(F.octet_length("j.text")).cast("long").alias("bytes"))


@query("SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n_turns, md5(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' AND role IN ('user', 'assistant') AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1")
def s9_event_jsonl(v: Views) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other")
    rows = _json_lines(v, type=F.lit("event_msg"), payload=F.struct(kind.alias("type"), F.col("text").alias("message")))
    heads = v.conversations.filter("turn = 0").select(F.concat(F.lit("/x/"), F.col("conv_id").cast("string")).alias("file"), F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_name().alias("id")).alias("payload"))).alias("line"))
    return _digested(t.sessions(t.event_jsonl(rows.union(heads))))


@query("SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n FROM conversations WHERE role = 'system' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) GROUP BY 1")
def s10_custom_jsonl(v: Views) -> DataFrame:
    kind = F.when(F.col("role") == "system", "custom").otherwise("message")
    rows = _json_lines(v, type=kind, customType=F.lit("signal"), data=F.struct(F.col("turn")), message=F.struct(F.col("role"), F.col("text").alias("content")))
    heads = v.conversations.filter("turn = 0").select(F.concat(F.lit("/x/"), F.col("conv_id").cast("string")).alias("file"), F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(F.lit("session").alias("type"), _name().alias("id"))).alias("line"))
    _, signals = t.custom_jsonl(rows.union(heads))
    return signals.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n_turns, md5(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' AND role <> 'system' GROUP BY 1")
def s11_message_json(v: Views) -> DataFrame:
    whole = v.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    docs = whole.select(_name().alias("s"), "m").select(F.concat(F.lit("/x/"), "s").alias("file"), F.to_json(F.struct(F.col("s").alias("session_id"), F.col("m").alias("messages"))).alias("value"))
    dumps = docs.select(F.concat(F.lit("/a/"), "file").alias("file"), F.regexp_replace("value", '"messages"', '"old"').alias("value"))
    return _digested(t.sessions(t.message_json(docs.union(dumps))))


@query("""WITH c AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'dump' WHEN conv_id % 3 = 1 THEN 'both' ELSE 'live' END AS shape FROM conversations)
SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n_turns, md5(string_agg('[' || role || '] ' || CASE WHEN shape = 'dump' THEN 'dumped ' ELSE '' END || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM c WHERE trim(text) <> '' AND role <> 'system' GROUP BY conv_id""")
def s11_dumps(v: Views) -> DataFrame:
    """Sessions of which some have a dumped request only, without an id in it, and some have a live document beside."""
    turn = lambda text: F.sort_array(F.collect_list(F.struct("turn", "role", text.alias("content"))))
    whole = v.conversations.groupBy("conv_id").agg(turn(F.col("text")).alias("m"), turn(F.concat(F.lit("dumped "), "text")).alias("d"))
    live = whole.filter("conv_id % 3 <> 0").select(F.concat(F.lit("/x/live-"), "conv_id").alias("file"), F.to_json(F.struct(_name().alias("session_id"), F.col("m").alias("messages"))).alias("value"))
    dumps = whole.filter("conv_id % 3 <> 2").select(F.concat(F.lit("/a/"), _name(), F.lit(".json")).alias("file"), F.to_json(F.struct(F.lit("").alias("session_id"), F.struct(F.struct(F.col("d").alias("messages")).alias("body")).alias("request"))).alias("value"))
    return _digested(t.sessions(t.message_json(live.union(dumps))))


@query("""WITH c AS (SELECT *, CASE WHEN role = 'assistant' AND conv_id % 4 = 1 THEN 'error' END AS stop FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT conv_id, coalesce(bool_or(role = 'user' AND trim(text) <> ''), false) AND NOT (coalesce(bool_or(role = 'assistant' AND trim(text) <> ''), false) AND coalesce(bool_or(role = 'assistant' AND stop IS NULL), false)) AS aborted FROM c GROUP BY 1)
SELECT 'conv_' || c.conv_id || '_z' AS session, any_value(aborted) AS aborted, count(*) AS n_turns, md5(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM c JOIN a USING (conv_id) WHERE trim(text) <> '' GROUP BY c.conv_id""")
def s10_sessions(v: Views) -> DataFrame:
    """Sessions of messages, of which every fourth has errors for answers; texts are lists of blocks in some."""
    stop = F.when((F.col("role") == "assistant") & (F.col("conv_id") % 4 == 1), "error")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    content = F.when(F.col("conv_id") % 2 == 0, blocks).otherwise(F.col("text"))
    rows = _json_lines(v, type=F.lit("message"), message=F.struct(F.col("role"), content.alias("content"), stop.alias("stopReason")))
    heads = v.conversations.select("conv_id").distinct().select(F.concat(F.lit("/x/"), F.col("conv_id").cast("string")).alias("file"), F.lit(-1).cast("long").alias("pos"), F.to_json(F.struct(F.lit("session").alias("type"), _name().alias("id"))).alias("line"))
    found = t.custom_sessions(rows.union(heads))
    return found.select("session", "aborted", "n_turns", F.md5("body").alias("digest"))


@query("SELECT 'conv_' || conv_id || '_z' AS session, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' AND conv_id % 5 <> 0 GROUP BY 1")
def s12_relational(v: Views) -> DataFrame:
    heads = v.conversations.select(_name().alias("id"), (F.col("conv_id") % 5 == 0).alias("archived")).distinct()
    messages = v.conversations.select(_name().alias("session_id"), "role", "text", F.col("turn").alias("at"), F.lit(False).alias("ignored"))
    return _digested(t.sessions(t.relational(heads, messages), t.plain))


@query("SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS n_turns, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' AND role <> 'system' GROUP BY 1")
def s13_keyed_rows(v: Views) -> DataFrame:
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    rows = v.conversations.select(F.concat_ws(":", F.lit("bubble"), "conv_id", "turn").alias("key"), F.to_json(F.struct(kind.alias("type"), F.col("text").alias("text"))).alias("value"))
    return _digested(t.sessions(t.keyed_rows(rows), t.plain))


@query("""WITH c AS (SELECT *, conv_id % 2 = 0 AS tab FROM conversations)
SELECT CASE WHEN tab THEN 'crc_' ELSE 'crw_' END || conv_id AS session, count(*) AS n_turns, md5(string_agg(CASE WHEN tab AND role <> 'user' THEN 'assistant' ELSE role END || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn)) AS digest
FROM c WHERE trim(text) <> '' AND (tab OR role IN ('user', 'assistant')) GROUP BY conv_id, tab""")
def s13_workspace_rows(v: Views) -> DataFrame:
    """Three workspaces, each with one value for its composers and one for its chat tabs; composers' turns go by type or by role."""
    k = F.col("conv_id")
    kind = F.when(F.col("role") == "user", "1").when(F.col("role") == "assistant", "2")
    tab = k % 2 == 0
    turn = F.struct("turn", F.when(tab, F.col("role")).when(F.col("turn") % 2 == 0, kind).alias("type"), F.when(~tab & (F.col("turn") % 2 == 1), F.col("role")).alias("role"), F.when(~tab | (F.col("turn") % 3 > 0), F.col("text")).alias("text"), F.when(tab & (F.col("turn") % 3 == 0), F.col("text")).alias("rawText"))
    each = v.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("c")).withColumn("space", k % 3)
    composers = each.filter(~tab).groupBy("space").agg(F.to_json(F.struct(F.collect_list(F.struct(k.cast("string").alias("composerId"), F.lit(5).alias("createdAt"), F.col("c").alias("conversation"))).alias("allComposers"))).alias("value"))
    tabs = each.filter(tab).groupBy("space").agg(F.to_json(F.struct(F.collect_list(F.struct(k.cast("string").alias("tabId"), F.lit(5).alias("lastSendTime"), F.col("c").alias("bubbles"))).alias("tabs"))).alias("value"))
    rows = composers.select(F.lit(t.COMPOSERS).alias("key"), "value").union(tabs.select(F.lit(t.CHATS), "value"))
    return _digested(t.sessions(t.workspace_rows(rows), t.plain))


@query("""WITH r AS (SELECT 'block_jsonl' AS reader, 'conv_' || conv_id || '_z' AS session, turn FROM conversations WHERE trim(text) <> '' UNION ALL SELECT 'generic_jsonl', 'conv_' || conv_id || '_z', turn FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT 'keyed_rows', CAST(conv_id AS VARCHAR), turn FROM conversations WHERE role IN ('user', 'assistant')) SELECT reader, session, count(*) AS n, min(turn) AS first, max(turn) AS last FROM r GROUP BY 1, 2""")
def s16_by_reader(v: Views) -> DataFrame:
    """The turns that readers make of the same conversations."""
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
    blocks = _json_lines(v, type=F.col("role"), sessionId=_name(), message=F.struct(F.col("role"), block.alias("content")))
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    keyed = v.conversations.select(F.concat_ws(":", F.lit("bubble"), "conv_id", "turn").alias("key"), F.to_json(F.struct(kind.alias("type"), F.col("text").alias("text"))).alias("value"))
    generic = lambda rows: t.READERS["generic_jsonl"](rows, {"content": "c", "role": "r", "session_id": "s"})
    made = {"block_jsonl": t.READERS["block_jsonl"](blocks).filter("text <> ''"), "generic_jsonl": generic(_json_lines(v, c=F.col("text"), r=F.col("role"), s=_name())), "keyed_rows": t.READERS["keyed_rows"](keyed)}
    counts = [turns.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last")).select(F.lit(name).alias("reader"), "*") for name, turns in made.items()]
    return counts[0].union(counts[1]).union(counts[2])


#: A user's turn is one line, so its line breaks are made spaces; other turns keep all lines.
LOG = r"""l AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN '#### ' || regexp_replace(text, '\s+', ' ', 'g') ELSE text END AS t FROM conversations),
b AS (SELECT conv_id, turn // 4 AS part, string_agg(t, chr(10) ORDER BY turn) AS b FROM l GROUP BY 1, 2), c AS (SELECT conv_id, part, string_split(chr(10) || b, chr(10) || '#### ')[2:] AS c FROM b),
d AS (SELECT conv_id, part, unnest(c) AS d, generate_subscripts(c, 1) AS k FROM c), e AS (SELECT conv_id, part, k, trim(string_split(d, chr(10))[1], ' ' || chr(9) || chr(10) || chr(13)) AS u, trim(array_to_string(string_split(d, chr(10))[2:], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS a FROM d),
f AS (SELECT conv_id, part, k, u, trim(array_to_string(list_transform(string_split(a, chr(10)), lambda x: CASE WHEN starts_with(x, '> ') THEN '[tool_action: ' || substr(trim(substr(x, 3)), 1, 200) || ']' ELSE x END), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS a FROM e),
g AS (SELECT conv_id, part, 2 * k AS k, 'user' AS role, u AS t FROM f WHERE u <> '' UNION ALL SELECT conv_id, part, 2 * k + 1, 'assistant', a FROM f WHERE a <> '')"""


@query("WITH " + LOG + """ SELECT conv_id, 'ai_20240102_0' || part || '0405' AS session, count(*) AS n_turns, count(*) FILTER (role = 'user') AS users, md5(string_agg(role || ': ' || t, chr(10) ORDER BY k)) AS digest,
min(part)::INT AS starts_hour, coalesce((SELECT min(b2.part) FROM b b2 WHERE b2.conv_id = g.conv_id AND b2.part > g.part), g.part)::INT AS ends_hour FROM g GROUP BY conv_id, part""")
def s14_markdown_log(v: Views) -> DataFrame:
    """Four turns are a session that starts an hour after the one before."""
    file, part = F.concat(F.lit("/x/"), F.col("conv_id").cast("string")), F.floor(F.col("turn") / 4)
    said = F.when(F.col("role") == "user", F.concat(F.lit("#### "), F.regexp_replace("text", r"\s+", " "))).otherwise(F.col("text"))
    rows = v.conversations.select(file.alias("file"), "turn", F.posexplode(F.split(said, "\n")).alias("k", "line")).select("file", ((F.col("turn") + 1) * 1_000_000 + F.col("k")).alias("pos"), "line")
    heads = v.conversations.groupBy(file.alias("file"), part.alias("part")).agg(((F.min("turn") + 1) * 1_000_000 - 1).alias("pos"))
    heads = heads.select("file", "pos", F.concat(F.lit("# tool chat started at 2024-01-02 0"), F.col("part").cast("string"), F.lit(":04:05")).alias("line"))
    turns = t.markdown_log(rows.union(heads))
    digest = F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.concat("role", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n"))
    out = turns.groupBy("file", "session").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("users"), digest.alias("digest"), F.hour(F.min("ts")).alias("starts_hour"), F.hour(F.max("ends_at")).alias("ends_hour"))
    return out.select(F.substring("file", 4, 20).cast("long").alias("conv_id"), "session", "n_turns", "users", "digest", "starts_hour", "ends_hour")


@query(BODY.format("CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text"))
def s15_generic_jsonl(v: Views) -> DataFrame:
    rows = _json_lines(v, c=F.col("text"), r=F.col("role"), s=_name())
    return _digested(t.sessions(t.generic_jsonl(rows, {"content": "c", "role": "r", "session_id": "s"}), t.titled))


@query("SELECT doc_id, 'webhook_' || substr(sha256(source || '|' || CAST(n_chars AS VARCHAR) || '|' || substr(text, 1, 4000)), 1, 16) AS id FROM documents")
def s17_webhook(v: Views) -> DataFrame:
    rows = v.documents.select("doc_id", F.col("source").alias("runtime"), F.col("n_chars").alias("started_at"), "text")
    return t.pushed(rows).select("doc_id", "id")


@query("SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n FROM conversations GROUP BY 1")
def s16_turn_counts(v: Views) -> DataFrame:
    """What every reader's turns come to."""
    return v.conversations.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("n"))


