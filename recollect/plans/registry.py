"""How queries are registered: a function over views, and DuckDB SQL over the same views.

The driver's tables stand in for session stores, logs and graphs by the proxies below. Each proxy is one SQL text that
both engines run; `{name}` stands for a table or another proxy.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The clocks of the queries; no operator reads one of its own.
NOW, NOW_SESSIONS = "2024-01-31 00:00:00", "2001-08-02 00:00:00"

PROXIES = {
    "sessions": """SELECT 's' || CAST(o_orderkey AS STRING) AS id, o_orderkey AS seq, o_custkey AS user_id, 'w' || CAST(o_custkey % 50 AS STRING) AS workstream_id,
  't' || CAST(o_custkey % 2 AS STRING) AS tenant_id, o_orderdate AS started_at, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL '2' HOUR END AS ended_at,
  CASE WHEN o_orderkey % 17 = 0 THEN 'superseded' WHEN o_orderkey % 23 = 0 THEN 'replaced' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'closed' END AS status,
  o_orderpriority AS label, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS runtime, o_totalprice AS size,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN 'global' ELSE 'r' || CAST(o_custkey % 5 AS STRING) END AS scope FROM {orders}""",
    "ordered": "SELECT id, seq, user_id, started_at, status, lag(id) OVER (PARTITION BY user_id ORDER BY started_at, seq) AS before FROM {sessions}",
    "edges": """SELECT id AS from_session, before AS to_session, CASE WHEN seq % 5 = 0 THEN 'supersedes' WHEN seq % 7 = 0 THEN 'replaces' ELSE 'continues' END AS kind
  FROM {ordered} WHERE before IS NOT NULL""",
    "session_entities": "SELECT DISTINCT 's' || CAST(l_orderkey AS STRING) AS session_id, 'e' || CAST(l_partkey % 400 AS STRING) AS entity FROM {lineitem}",
    "facts": """SELECT 'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id, 's' || CAST(l_orderkey AS STRING) AS session_id,
  'e' || CAST(l_partkey % 400 AS STRING) AS subject, min(CASE WHEN l_suppkey % 3 = 0 THEN 'stack' WHEN l_suppkey % 3 = 1 THEN 'owner' ELSE 'port' END) AS predicate,
  min(l_returnflag || l_linestatus || CAST(CAST(l_quantity AS INT) % 4 AS STRING)) AS value, min(CASE WHEN l_linenumber % 3 = 0 THEN 'decision' WHEN l_linenumber % 3 = 1 THEN 'open' ELSE 'attribute' END) AS kind,
  min(l_shipdate) AS created_at, min(0.3 + CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE) / 10) AS confidence, max(CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END) AS retired
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey""",
    "versions": """SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY created_at DESC, id DESC) AS version,
  lag(id) OVER (PARTITION BY subject, predicate ORDER BY created_at DESC, id DESC) AS superseded_by FROM {facts}""",
    "decided": """SELECT l_orderkey AS id, l_partkey, l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS decided_at FROM {lineitem}
  UNION ALL SELECT l_orderkey + 1, l_partkey, l_suppkey, CAST(l_shipdate AS TIMESTAMP) + INTERVAL '30' DAY FROM {lineitem} WHERE l_orderkey % 100 = 0""",
    "signals": """SELECT event_id, ts, 'r' || CAST(user_id % 20 AS STRING) AS repo, 'm' || CAST(event_id % 3 AS STRING) AS model, CASE WHEN event_id % 4 = 0 THEN 'gate' WHEN event_id % 4 = 1 THEN 'eval' WHEN event_id % 4 = 2 THEN 'review' ELSE 'test' END AS kind,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_type END AS step, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'click' THEN 'fix' WHEN event_type = 'signup' THEN 'exhausted' ELSE 'pass' END AS outcome,
  's' || CAST(event_id * 4 AS STRING) AS session_id, 'u' || CAST(user_id AS STRING) AS producer FROM {events}""",
    "queries_log": """SELECT event_id, ts, 'c' || CAST(user_id AS STRING) AS conversation_id, CASE WHEN user_id % 3 = 0 THEN 'http' WHEN user_id % 3 = 1 THEN 'mcp_tool' ELSE 'hook' END AS source,
  CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 6 END AS n_results, CASE WHEN event_id % 31 = 0 THEN ' Smoke run ' WHEN event_id % 37 = 0 THEN 'x' ELSE ' ' || upper(event_type) || ' K' || CAST(user_id % 10 AS STRING) END AS query,
  's' || CAST(event_id % 300 AS STRING) AS returned_id, event_type FROM {events}""",
    "surfaced": "SELECT conversation_id, source, returned_id AS id FROM {queries_log} WHERE event_type <> 'purchase'",
    "cited": "SELECT conversation_id, returned_id AS id, ts FROM {queries_log} WHERE event_type = 'purchase'",
    "papers": "SELECT doc_id, substr(text, 1, 80) AS label, text AS body, substr(text, 81, 160) AS summary, lang, source FROM {documents}",
    "workstreams": "SELECT 'w' || CAST(c_custkey AS STRING) AS id, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN 'w' || CAST(c_custkey / 3 AS BIGINT) END AS merged_into, c_mktsegment AS segment FROM {customer}",
}
# Integer division differs between the engines; this is exact, as the key is a multiple of 3 there.
PROXIES["workstreams"] = PROXIES["workstreams"].replace("CAST(c_custkey / 3 AS BIGINT)", "CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT)")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """Tables and proxies as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in PROXIES:
            sql = PROXIES[name]
            found = self.spark.sql(sql, **{x: getattr(self, x) for x in set(_NAME.findall(sql))})
        else:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, found)
        return found


def with_proxies(sql: str) -> str:
    """`sql` with the proxies that it names in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PROXIES:
            if name not in needed and re.search(rf"(?<![\w.]){name}(?!\w)", text):
                visit(" ".join(_NAME.findall(PROXIES[name])))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({_NAME.sub(lambda m: m[1], PROXIES[n])})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"


def query(sql: str | None = None, **values: object):
    """Registers a function of views under its name; `sql` is DuckDB SQL for the same rows, with values for `$name`."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            text = sql
            for k, v in ({"now": f"TIMESTAMP '{NOW}'", "then": f"TIMESTAMP '{NOW_SESSIONS}'"} | values).items():
                text = text.replace(f"${k}", str(v))
            ORACLE_SQL[f.__name__] = with_proxies(text)
        return f

    return register
