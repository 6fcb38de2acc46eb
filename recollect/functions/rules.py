"""Rules on prompts, queries and names, as column expressions. Word lists and patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, RIGHT


def path_shaped(name: Column) -> Column:
    return F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")) | name.startswith(".") | name.rlike(r"(?i)\.(ts|js|py|rs|go|html|md|json)$")


# The harness's tags, bare acknowledgements, leading fillers and generative openers.
TAGS = "ide_selection ide_opened_file ide_closed_file ide_diagnostics ide_recently_modified_file task-notification system-reminder command-name command-message command-args local-command-stdout local-command-stderr".split()
ACKNOWLEDGED = "yes|yep|yeah|sure|ok|okay|k|thanks|thank you|ty|done|nice|cool|great|perfect|continue|next|go|go ahead|do it|yes please|sounds good|good|got it|right|correct"
FILLER = "please|can you|could you|would you|will you|i need you to|i'd like you to|i want you to|i would like you to|help me|let's|lets|hey|ok|okay"
GENERATIVE = "write|draft|create|compose|generate|brainstorm|design|outline|sketch|invent|rename|come up with"


def prompt_class(prompt: Column) -> Column:
    """skip, generative or evaluate."""
    p = F.regexp_replace(prompt, f"(?is)<({'|'.join(TAGS)}){RIGHT}[^>]*>.*?(?:</\\1>|$)", " ")
    p = F.trim(F.regexp_replace(p, r"\s+", " "))
    bare = ~p.rlike("[A-Za-z0-9]{2,}") | p.rlike(rf"(?i)^({ACKNOWLEDGED})\W*$")
    rest = p
    for _ in range(3):
        rest = F.regexp_replace(rest, rf"(?i)^({FILLER}){RIGHT}[\s,]*", "")
    rest = F.trim(rest)
    return F.when(bare | ~rest.rlike("[A-Za-z0-9]{2,}"), "skip").when(rest.rlike(f"(?i)^({GENERATIVE}){RIGHT}"), "generative").otherwise("evaluate")


# What makes a query relational or temporal.
RELATIONAL = [r"depends\s+on", r"related\s+to", r"connected\s+(?:to|with)", r"what\s+uses", r"downstream\s+of"]
TEMPORAL = [
    r"\d+\s+(?:day|week|month|year)s?\s+ago", r"(?:last|past|next)\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)", r"when\s+did", "ago",
    "(?:yesterday|today|tomorrow)", r"how\s+(?:long|many)\s+(?:days?|weeks?|months?|years?)\s+ago",
]
NOT_NAMES = "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december i i'd i've i'm i'll".split()


def has_temporal(q: Column) -> Column:
    return q.rlike(f"(?i){LEFT}(?:{'|'.join(TEMPORAL)}){RIGHT}") | q.rlike(rf"{LEFT}(?:before|after)\s+I{RIGHT}")


def has_name(q: Column) -> Column:
    """A token after the first one in capitals or of mixed case, other than days, months and I."""
    words = F.filter(F.split(q, r"[\s,.;:!?()\"'`]+"), lambda t: t != "")
    named = lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*NOT_NAMES) & (t.rlike("^[A-Z]{2,}$") | t.rlike("[A-Z]") & t.rlike("[a-z]"))
    return F.exists(F.slice(words, 2, F.greatest(F.lit(1), F.size(words))), named)


def query_intent(q: Column) -> Column:
    return F.when(F.trim(q) == "", "other").when(q.rlike(f"(?i){LEFT}(?:{'|'.join(RELATIONAL)}){RIGHT}"), "relational").when(has_temporal(q), "temporal").otherwise("lookup")


# Words that carry no content in a query.
STOP = """a an the is are was were be been being have has had do does did will would could should may might shall can dare ought yes no not please thank thanks ok okay
i me my we us our you your it its this that these those and or but if so to of in on at by for from with about into through during before after above below up down out
off over under again further then once here there when where why how all both each few more most other some such than too very just now also get let what which who whom
whose any much many sounds good great sure right well done nice cool perfect exactly proceed continue go ahead next help""".split()


# Tags of the harness that open a message which is no query.
HARNESS = "task-notification command-name command-message command-args local-command-stdout local-command-caveat output-file system-reminder".split()


def recall_query(prompt: Column) -> Column:
    """The content words of a prompt in order, or null with fewer than two, and for messages of the harness."""
    words = F.transform(F.split(F.trim(prompt), r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9_-]+|[^A-Za-z0-9_-]+$", ""))
    words = F.filter(words, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*STOP))
    own = prompt.rlike(rf"^\s*<({'|'.join(HARNESS)}){RIGHT}")
    return F.when((F.size(words) >= 2) & ~own, F.array_join(words, " "))


# Words that carry no topic.
NO_TOPIC = """the a an and or but is are was were be been being do does did doing you your i we our it its this that these those what which how why when where who can could
would should will shall may might must please to of in on for with so now then here there just also as at by if my me us ok okay yes no not up out go get got make made
give tell want need think know let lets about from into""".split()


def topical_words(text: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), 1), lambda t: ~t.isin(*NO_TOPIC)))


def live_status(status: Column, age_minutes: Column) -> Column:
    """Superseded and replaced stay; else by the age of the transcript."""
    return F.when(status.isin("superseded", "replaced"), status).when(age_minutes < 15, "active").when(age_minutes < 1440, "idle").otherwise("closed")


def as_millis(value: Column) -> Column:
    """A number above 1e10 is milliseconds, below it seconds; 0 and null are unknown."""
    return F.when(value.isNull() | (value == 0), F.lit(None)).when(value > 1e10, value.cast("long")).otherwise((value * 1000).cast("long"))


def timestamp_text(text: Column, number: Column) -> Column:
    """A time as it was written, or a number as ISO text in UTC; empty for neither."""
    iso = F.date_format(F.timestamp_millis(as_millis(number)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(text != "", text).otherwise(F.coalesce(F.when(text.isNull(), iso), F.lit("")))


def duration_minutes(start: Column, end: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 60_000_000)), F.lit(0))


def safe_session_id(raw: Column) -> Column:
    parts = F.split(raw, "_")
    return F.when(F.size(parts) >= 3, F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.element_at(parts, -1))).otherwise(raw)


def short_summary(text: Column, most: int = 200, least: int = 60) -> Column:
    """Cut after the last sentence that ends in [least, most], else at the last space there, else hard."""
    head = F.substring(text, 1, most)
    sentence = F.regexp_extract(head, rf"(?s)^(.{{{least},}}[.!?])(?:\z| )", 1)
    words = F.regexp_extract(head, rf"(?s)^(.{{{least},}}) ", 1)
    return F.when(F.length(text) <= most, text).when(sentence != "", sentence).when(words != "", F.concat(words, F.lit(" ..."))).otherwise(F.concat(head, F.lit(" ...")))
