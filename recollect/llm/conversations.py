"""Conversation structure repair: cheapest edits by dynamic programming over a prefix trie of signatures.

A row has one fault at most: blank (nothing but white space), duplicate (role and text seen earlier in its conversation),
truncated (its last character that isn't white space ends no sentence). A row's symbol is its role's initial and whether it
is truncated, or that it must go; a conversation's signature is its rows' symbols in order. Conversations with the same
signature have the same repair, those whose signatures begin alike share the beginning of the work: signatures are dealt out
by range and sorted, so that going from one to the next is a walk through their prefix trie. A layer of the programme (the
least cost of each state after a prefix) is computed once when the walk enters a node, kept while it is below, and answers are emitted
at terminal nodes. A signature that a third of all conversations have is split by the conversation's id.

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2, the only one for a blank or duplicate row); an Insert of an empty
user or assistant turn (5) anywhere; a truncated row that stays costs 5 more. The result's role initials are `(s?(ua)+)?`.
Among the cheapest repairs that with the least audit (the edits' initials, by ASCII) is taken. States: nothing yet, after
the system turn, after a user, after an assistant.

Texts are shuffled once, by conversation; afterwards only signatures are, and ids. Symbols, counts and the repaired
turns are column expressions. A conversation is a unit like a document: its turns have to fit a row.

Cases: null roles and texts are one space, so that such a text is blank; rows are ordered by turn, null turns first, and ties by
role and text; rows that are repeated in all of conversation, turn, role and text are duplicates but for the first; a
null conversation id is a conversation; very long texts are only looked at in column expressions; an empty table gives no
rows; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

SPACES = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: The state that a turn of a role leads to, from each state; none where the turn can't follow.
AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A user's or an assistant's turn, whichever can follow.
NEXT = AFTER["u"] | AFTER["a"]
FAR = 1 << 60


def steps(symbol: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) of a row with this symbol: `d` must go, capitals are truncated, `o` is any other role."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if symbol != "d":
        more = TRUNCATED * symbol.isupper()
        out += [("K", q, to, more) for q, to in AFTER.get(symbol.lower(), {}).items()]
        out += [("R", q, to, more + REROLE) for q, to in NEXT.items()]
    return out


STEPS = {s: steps(s) for s in "dsuaoSUAO"}


def _with_inserts(layer: list[int]) -> list[int]:
    """Inserts add turns between rows; three in a row would come back to a state at a higher cost."""
    for _ in range(3):
        for q, to in NEXT.items():
            layer[to] = min(layer[to], layer[q] + INSERT)
    return layer


class Trie:
    """A walk through the prefix trie of signatures that come in order; `layers` are those of the path to the present node."""

    def __init__(self):
        self.path, self.layers, self.answer, self.computed = "", [_with_inserts([0, FAR, FAR, FAR])], None, 0

    def repair(self, signature: str) -> tuple[int, str]:
        """The least cost, and the least audit of that cost."""
        if self.answer and signature == self.path:
            return self.answer
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            before, layer = self.layers[-1], [FAR] * 4
            for _, q, to, cost in STEPS[symbol]:
                layer[to] = min(layer[to], before[q] + cost)
            self.layers.append(_with_inserts(layer))
            self.computed += 1
        self.path = signature
        self.answer = min(self.layers[-1][q] for q in ENDS), self._audit(signature)
        return self.answer

    def _audit(self, signature: str) -> str:
        layers, n = self.layers, len(signature)
        least = min(layers[n][q] for q in ENDS)
        marked = [set() for _ in layers]  # states on a cheapest way
        marked[n] = {q for q in ENDS if layers[n][q] == least}
        for i in range(n, -1, -1):
            for _ in range(3):
                marked[i] |= {q for q, to in NEXT.items() if to in marked[i] and layers[i][q] + INSERT == layers[i][to]}
            if i:
                marked[i - 1] = {q for _, q, to, cost in STEPS[signature[i - 1]] if to in marked[i] and layers[i - 1][q] + cost == layers[i][to]}
        out, i, here = [], 0, {NOTHING}
        while i < n or not any(q in ENDS and layers[n][q] == least for q in here):
            ways: dict[str, set[int]] = {}
            for q in here:
                if (to := NEXT.get(q)) in marked[i] and layers[i][q] + INSERT == layers[i][to]:
                    ways.setdefault("I", set()).add(to)
            for edit, q, to, cost in STEPS[signature[i]] if i < n else ():
                if q in here and to in marked[i + 1] and layers[i][q] + cost == layers[i + 1][to]:
                    ways.setdefault(edit, set()).add(to)
            edit = min(ways)
            out.append(edit)
            here, i = ways[edit], i + (edit != "I")
        return "".join(out)


def rendered(signature: str, audit: str) -> tuple[list[int | None], list[str | None]]:
    """Each repaired turn's row, null for an inserted one, and its new role, null for the row's own."""
    rows, roles, state, i = [], [], NOTHING, 0
    for edit in audit:
        if edit != "D":
            state = AFTER[signature[i].lower()][state] if edit == "K" else NEXT[state]
            rows.append(None if edit == "I" else i)
            roles.append(None if edit == "K" else "user" if state == USER else "assistant")
        i += edit != "I"
    return rows, roles


def _answers(signed: DataFrame) -> DataFrame:
    """(conv_, signature) with cost, audit, rows_ and roles_."""
    kind = signed.schema["conv_"].dataType.simpleString()
    dealt = signed.repartitionByRange("signature", "conv_").sortWithinPartitions("signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, plan = Trie(), None, ([], [])
        for b in batches:
            out: list[list] = [[], [], [], []]
            for signature in b.column(1).to_pylist():
                cost, audit = trie.repair(signature)
                if signature != last:
                    last, plan = signature, rendered(signature, audit)
                for column, value in zip(out, (cost, audit, *plan)):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], ["conv_", "cost", "audit", "rows_", "roles_"])

    return dealt.mapInArrow(run, f"conv_ {kind}, cost long, audit string, rows_ array<int>, roles_ array<string>")


def signed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: conv_, turns_ in order, signature, and counts of what is wrong."""
    space = F.lit(" ")
    rows = turns.select(F.col(conv).alias("conv_"), F.col(turn).cast("long").alias("turn_"), F.coalesce(F.col(role), space).alias("role_"), F.coalesce(F.col(text), space).alias("text_"))
    order = Window.partitionBy("conv_").orderBy(F.col("turn_").asc_nulls_first(), "role_", "text_")
    same = Window.partitionBy("conv_", "role_", "text_").orderBy("at_")
    initial = F.substring("role_", 1, 1)
    rows = rows.withColumns({"at_": F.row_number().over(order), "pair_": F.concat(F.lag(initial).over(order), initial), "new_turn_": F.coalesce(F.lag("turn_").over(order) != F.col("turn_"), F.col("turn_").isNotNull())})
    rows = rows.withColumn("seen_", F.row_number().over(same) > 1)
    last = F.right(F.rtrim("text_", F.lit(SPACES)), F.lit(1))
    rows = rows.withColumn("fault_", F.when(last == "", "blank").when(F.col("seen_"), "duplicate").when(~last.isin(".", "!", "?"), "truncated"))
    lower = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault_").isin("blank", "duplicate"), "d").when(F.col("fault_") == "truncated", F.upper(lower)).otherwise(lower)
    fault = lambda name: F.count_if(F.col("fault_") == name).alias(name)
    found = rows.groupBy("conv_").agg(
        F.sort_array(F.collect_list(F.struct("at_", symbol.alias("symbol_"), "role_", "text_"))).alias("all_"),
        F.coalesce(F.max("turn_") - F.min("turn_") + 1 - F.count_if("new_turn_"), F.lit(0)).alias("gaps"),
        fault("blank"), fault("duplicate"), fault("truncated"), F.count_if(~F.col("pair_").isin("su", "ua", "au")).alias("illegal"),
    )
    turns_ = F.transform("all_", lambda x: F.struct(x["role_"].alias("role"), x["text_"].alias("text")))
    return found.select("conv_", turns_.alias("turns_"), F.array_join("all_.symbol_", "").alias("signature"), "gaps", "blank", "duplicate", "truncated", "illegal")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation's gaps, blank, duplicate, truncated, illegal, cost, audit, and its `repaired` turns (role, text)."""
    found = written(signed(turns, conv, turn, role, text), "turns")
    answers = _answers(found.select("conv_", "signature")).withColumnRenamed("conv_", "of_")
    both = found.join(answers, F.col("conv_").eqNullSafe(F.col("of_")))
    own = lambda x: F.get("turns_", x["rows_"])
    repaired = F.transform(F.arrays_zip("rows_", "roles_"), lambda x: F.struct(F.coalesce(x["roles_"], own(x)["role"]).alias("role"), F.coalesce(own(x)["text"], F.lit("")).alias("text")))
    return both.select(F.col("conv_").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repaired.alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage by a hash of conversation and turn: one row in twenty each is dropped, emptied, loses its sentence ends, is repeated, is a user's."""
    space = F.lit(" ")
    words = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind: Column = F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", words("role").alias("role"), words("text").alias("text"), kind.alias("kind_")).filter("kind_ != 0")
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind_") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy_")).drop("copy_")


def digest(repaired: str) -> Column:
    """The lower-case hex SHA-256 of the turns as `role:text`, joined by newlines."""
    return F.sha2(F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)


#: The same of damaged conversations in DuckDB SQL; equal costs never have audits of which one begins the other, so that the best of each state suffices.
ORACLE = """WITH RECURSIVE bits AS (SELECT n, 0 AS k, n AS c FROM range(256) r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM conversations, tab),
bad AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || substr(role, 1, 1) AS pair,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM bad),
faults AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (SELECT g, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY g),
way(r, q, q2) AS (VALUES ('s', 'N', 'S'), ('u', 'N', 'U'), ('u', 'S', 'U'), ('u', 'A', 'U'), ('a', 'U', 'A')),
put(q, q2, c, e) AS (SELECT q, q, 0, '' FROM (VALUES ('N'), ('S'), ('U'), ('A')) x(q) UNION ALL SELECT q, q2, 5, 'I' FROM way WHERE r <> 's'
  UNION ALL SELECT q, CASE q2 WHEN 'U' THEN 'A' ELSE 'U' END, 10, 'II' FROM way WHERE r <> 's'),
edits AS (SELECT g, pos, e, q, q2, c + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 5 ELSE 0 END AS c FROM faults, (
    SELECT 'D' AS e, '' AS r, q, q AS q2, 2 AS c FROM (VALUES ('N'), ('S'), ('U'), ('A')) x(q) UNION ALL SELECT 'K', r, q, q2, 0 FROM way
    UNION ALL SELECT 'R', '', q, q2, 1 FROM way WHERE r <> 's') s
  WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR r = substr(role, 1, 1)))),
dp AS (SELECT g, 0 AS i, 'N' AS q, '000000000' AS best FROM counts
  UNION ALL SELECT d.g, d.i + 1, x.q2, min(lpad((substr(best, 1, 9)::INT + put.c + x.c)::VARCHAR, 9, '0') || substr(best, 10) || put.e || x.e)
  FROM dp d JOIN put ON put.q = d.q JOIN edits x ON x.g = d.g AND x.pos = d.i + 1 AND x.q = put.q2 GROUP BY d.g, d.i + 1, x.q2),
best AS (SELECT g, min(lpad((substr(best, 1, 9)::INT + put.c)::VARCHAR, 9, '0') || substr(best, 10) || put.e) AS b
  FROM dp JOIN counts USING (g) JOIN put ON put.q = dp.q WHERE i = n AND put.q2 IN ('N', 'A') GROUP BY g),
chars AS (SELECT g, unnest(string_split(substr(b, 10), '')) AS e, unnest(range(length(b) - 9)) AS p FROM best WHERE length(b) > 9),
spots AS (SELECT *, sum((e <> 'I')::INT) OVER (PARTITION BY g ORDER BY p) AS pos, sum((e <> 'D')::INT) OVER (PARTITION BY g ORDER BY p) AS k FROM chars),
kept AS (SELECT s.g, k, e, role, text, max(CASE WHEN k = 1 AND e = 'K' AND substr(role, 1, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.g) AS sys
  FROM spots s LEFT JOIN placed p ON p.g = s.g AND p.pos = s.pos AND e <> 'I' WHERE e <> 'D'),
texts AS (SELECT g, string_agg((CASE WHEN e = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN e = 'I' THEN '' ELSE text END), chr(10) ORDER BY k) AS t
  FROM kept GROUP BY g),
done AS (SELECT counts.*, substr(b, 1, 9)::BIGINT AS cost, substr(b, 10) AS audit, sha256(coalesce(t, '')) AS repaired_sha256 FROM counts JOIN best USING (g) LEFT JOIN texts USING (g))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
