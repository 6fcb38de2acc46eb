"""Queries of ranked retrieval: R1-R23, F2-F4, F14."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as s
from ..functions.text import snippet, token_set
from ..operators import facts as f
from ..operators import recall as r
from .registry import NOW, NOW_SESSIONS, Views, query

TOK = "list_transform(regexp_extract_all({}, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda x: lower(x))"


def _bm25(text: str = "text") -> str:
    """Postings with places in SQL; `text` is the queries' text."""
    index = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
    each = " UNION ALL ".join(f"SELECT doc_id, dl, {i} AS part, unnest({c}) AS term, generate_subscripts({c}, 1) AS place, {w}::DOUBLE AS w FROM d" for i, (c, w) in enumerate((("a", 10.0), ("b", 4.0), ("c", 1.0))))
    return f"""WITH q AS (SELECT item_id, array_to_string(regexp_extract_all(word, '[a-z0-9]+'), ' ') AS term, count(*) AS times FROM (SELECT item_id, unnest({TOK.format(text)}) AS word FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, {index.format('label')} AS a, {index.format('summary')} AS b, {index.format('body')} AS c, len(a) + len(b) + len(c) AS dl FROM papers),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
pt AS (SELECT term AS phrase, len(string_split(term, ' ')) AS m, unnest(string_split(term, ' ')) AS term, generate_subscripts(string_split(term, ' '), 1) AS off FROM (SELECT DISTINCT term FROM q)),
x AS (SELECT * FROM ({each}) WHERE term IN (SELECT term FROM pt)),
o AS (SELECT doc_id, dl, phrase, w FROM x JOIN pt USING (term) GROUP BY doc_id, dl, part, phrase, m, w, place - off HAVING count(*) = m),
p AS (SELECT doc_id, dl, phrase AS term, sum(w) AS f FROM o GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END::DOUBLE AS idf, avgdl FROM df, n),
k AS (SELECT item_id, doc_id, sum(times * idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN i USING (term) GROUP BY 1, 2)"""


def _keyword(v: Views, queries: DataFrame, k: int) -> DataFrame:
    """The k best documents of each passage, by scores of six digits."""
    found = r.keyword_scores(v.papers, queries, "doc_id", "item_id", "text", k=k, digits=6)
    return r.top(found.withColumn("order", s.rounded(F.col("score"), 6)), "item_id", "doc_id", k, "order")


@query(_bm25() + """, t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, doc_id) AS rank FROM k)
SELECT item_id, doc_id, floor(score * 1e4 + 0.5) / 1e4 AS score, rank FROM t WHERE rank <= 10""")
def r1_keyword_recall(v: Views) -> DataFrame:
    return _keyword(v, v.benchmark, 10).select("item_id", "doc_id", s.rounded(F.col("score")).alias("score"), "rank")


@query(_bm25("regexp_replace(text, ' ([A-Za-z0-9]+) ', '-\\1 ', 'g')") + """, t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, doc_id) AS rank FROM k)
SELECT item_id, doc_id, floor(score * 1e4 + 0.5) / 1e4 AS score, rank FROM t WHERE rank <= 10""")
def r1_phrases(v: Views) -> DataFrame:
    """Passages whose words hang together by twos: each pair is a phrase, which a text has to hold side by side."""
    asked = v.benchmark.withColumn("text", F.regexp_replace("text", " ([A-Za-z0-9]+) ", "-$1 "))
    return _keyword(v, asked, 10).select("item_id", "doc_id", s.rounded(F.col("score")).alias("score"), "rank")


@query(_bm25() + """, t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, doc_id) AS rank FROM k), gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
z AS (SELECT gold.item_id, min(rank) AS rank FROM gold LEFT JOIN (SELECT * FROM t WHERE rank <= 5) t USING (item_id, doc_id) GROUP BY 1)
SELECT count(*) AS queries, floor(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_1, floor(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_3,
floor(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_k, floor(avg(coalesce(1.0::DOUBLE / rank, 0)) * 1e4 + 0.5) / 1e4 AS mrr FROM z""")
def r1_keyword_quality(v: Views) -> DataFrame:
    """Recall at 1, 3 and 5 of the documents that hold a benchmark passage."""
    from ..operators.telemetry import retrieval_metrics

    ranked = _keyword(v, v.benchmark, 5)
    gold = r.holding(v.documents, v.benchmark, "doc_id", "item_id")
    return retrieval_metrics(ranked, gold, 5, "item_id", "doc_id")


KNN = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, label, list_distance(embedding::DOUBLE[], e::DOUBLE[]) AS distance FROM embeddings, q WHERE vec_id <> query_id)"""


def _asked(v: Views) -> DataFrame:
    return v.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _others(v: Views, k: int) -> DataFrame:
    """Every row but the query itself."""
    return r.nearest(v.embeddings, _asked(v), "vec_id", "query_id", k, others=True)


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT query_id, label, min(list_distance(embedding::DOUBLE[], e::DOUBLE[])) AS distance FROM embeddings, q GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, label) AS rank FROM d) SELECT query_id, label, floor(distance * 1e4 + 0.5) / 1e4 AS distance, rank FROM t WHERE rank <= 5")
def r2_semantic_by_session(v: Views) -> DataFrame:
    near = r.nearest(v.embeddings, _asked(v), "vec_id", "query_id", 5, group="label")
    return near.select("query_id", "label", s.rounded(F.col("distance")).alias("distance"), "rank")


@query(KNN + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, vec_id, floor(greatest(-1, least(1, 1 - distance * distance / 2)) * 1e4 + 0.5) / 1e4 AS similarity, rank FROM t WHERE rank <= 10")
def r3_cosine(v: Views) -> DataFrame:
    return _others(v, 10).select("query_id", "vec_id", s.cosine_of_l2(F.col("distance")).alias("similarity"), "rank")


# A passage's vector is that of its number, a document's that of its own; vectors are of unit length, or nearly so.
LEGS = """, kw AS (SELECT item_id, doc_id, floor(score * 1e6 + 0.5) / 1e6 AS p FROM k QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY floor(score * 1e6 + 0.5) / 1e6 DESC, doc_id) <= 30),
vec AS (SELECT item_id, x.vec_id AS doc_id, list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS d FROM benchmark JOIN embeddings y ON y.vec_id = item_id, embeddings x WHERE x.vec_id IN (SELECT doc_id FROM documents)),
sem AS (SELECT item_id, doc_id, floor(greatest(-1, least(1, 1 - d * d / 2)) * 1e4 + 0.5) / 1e4 AS x FROM vec QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY d, doc_id) <= 30)"""
MERGED = LEGS + """, m AS (SELECT coalesce(kw.item_id, sem.item_id) AS item_id, coalesce(kw.doc_id, sem.doc_id) AS doc_id, p, x FROM kw FULL JOIN sem ON kw.item_id = sem.item_id AND kw.doc_id = sem.doc_id),
h AS (SELECT item_id, doc_id, p IS NOT NULL AS in_primary, x IS NOT NULL AS in_secondary, CASE WHEN p IS NOT NULL THEN 0.5 + 0.5 * p / greatest(1, max(p) OVER (PARTITION BY item_id)) ELSE 0.5 * x / greatest(1, max(x) OVER (PARTITION BY item_id)) END AS score FROM m)"""


def _legs(v: Views) -> tuple[DataFrame, DataFrame]:
    kw = _keyword(v, v.benchmark, 30).select("item_id", "doc_id", F.col("order").alias("score"), "rank")
    asked = v.benchmark.select("item_id").join(v.embeddings.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    vectors = v.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding").join(v.documents.select("doc_id"), "doc_id", "left_semi")
    near = r.nearest(vectors, asked, "doc_id", "item_id", 30)
    return kw, near.select("item_id", "doc_id", s.cosine_of_l2(F.col("distance")).alias("score"))


@query(_bm25() + MERGED + " SELECT item_id, doc_id, floor(score * 1e4 + 0.5) / 1e4 AS score, in_primary, in_secondary FROM h")
def r4_hybrid_bands(v: Views) -> DataFrame:
    return r.hybrid(*_legs(v), "item_id", "doc_id").withColumn("score", s.rounded(F.col("score")))


FINAL = """, w AS (SELECT h.*, lang, source, TIMESTAMP '2024-01-31 00:00:00' - to_days((doc_id % 400)::INT) AS started_at, CASE WHEN doc_id % 5 = 0 THEN 'superseded' ELSE 'closed' END AS status FROM h JOIN documents USING (doc_id)),
y AS (SELECT *, floor(score * greatest(0.25, pow(2, -((doc_id % 400)) / 180)) * (CASE WHEN status = 'superseded' THEN 0.7 ELSE 1 END) * (1 + 0.13 * (lang = 'en')::INT + 0.02 * (source = 'src0')::INT) * 1e4 + 0.5) / 1e4 AS final, count(*) OVER (PARTITION BY item_id) AS total FROM w)"""


@query(_bm25() + MERGED + FINAL + " SELECT item_id, doc_id, final, total, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS rank FROM y QUALIFY rank <= 10")
def r9_finalise(v: Views) -> DataFrame:
    meta = v.documents.select("doc_id", F.expr(f"timestampadd(DAY, -CAST(doc_id % 400 AS INT), TIMESTAMP '{NOW}')").alias("started_at"), F.when(F.col("doc_id") % 5 == 0, "superseded").otherwise("closed").alias("status"),
                              (1 + s.DECISION_WEIGHT * (F.col("lang") == "en").cast("int") + s.ENTITY_WEIGHT * (F.col("source") == "src0").cast("int")).alias("tiebreak"))
    hits = r.hybrid(*_legs(v), "item_id", "doc_id").join(meta, "doc_id")
    return r.finalise(hits, NOW, "item_id", "doc_id", 10).select("item_id", "doc_id", "final", "total", "rank")


SHARED = "WITH q AS (SELECT item_id, list_distinct(" + TOK.format("text") + ") AS q FROM benchmark), "


@query(SHARED + f"""p AS (SELECT item_id, doc_id, q, {TOK.format('label')} AS a, {TOK.format('summary')} AS b, {TOK.format('body')} AS c FROM papers, q),
f AS (SELECT item_id, doc_id, array_to_string(list_filter([CASE WHEN list_has_any(a, q) THEN 'label' END, CASE WHEN list_has_any(b, q) THEN 'summary' END, CASE WHEN list_has_any(c, q) THEN 'body' END], lambda x: x IS NOT NULL), ',') AS fields FROM p)
SELECT * FROM f WHERE fields <> ''""")
def r5_match_fields(v: Views) -> DataFrame:
    """For each hit of each query, the fields that it was found in."""
    shared = r.shared_terms(v.papers, v.benchmark, "doc_id", "item_id", "text", ["label", "summary", "body"])
    fields = shared.groupBy("item_id", "doc_id").agg(F.bool_or(F.col("field") == "label").alias("a"), F.bool_or(F.col("field") == "summary").alias("b"), F.bool_or(F.col("field") == "body").alias("c"))
    return fields.select("item_id", "doc_id", F.concat_ws(",", F.when(F.col("a"), "label"), F.when(F.col("b"), "summary"), F.when(F.col("c"), "body")).alias("fields"))


@query("SELECT id, floor(greatest(0.25, CASE WHEN started_at >= $then THEN 1 ELSE pow(2, -(epoch_us($then) - epoch_us(started_at)) / 86400000000.0 / 180) END) * 1e4 + 0.5) / 1e4 AS decay FROM sessions")
def r6_recency(v: Views) -> DataFrame:
    return v.sessions.select("id", s.rounded(s.recency(F.col("started_at"), NOW_SESSIONS)).alias("decay"))


@query(SHARED + f"""p AS (SELECT item_id, doc_id, q, {TOK.format('label')} AS a, {TOK.format('summary')} AS b FROM papers, q)
SELECT item_id, doc_id, floor((1 + 0.13 * len(list_intersect(q, list_distinct(a))) / len(q) + 0.02 * len(list_intersect(q, list_distinct(b))) / len(q)) * 1e4 + 0.5) / 1e4 AS factor FROM p WHERE list_has_any(q, a) OR list_has_any(q, b)""")
def r7_tiebreak(v: Views) -> DataFrame:
    """The factor of each query's documents that share a term; that of any other is 1."""
    shared = r.shared_terms(v.papers, v.benchmark, "doc_id", "item_id", "text", ["label", "summary"])
    counts = shared.groupBy("item_id", "doc_id").agg(F.count_if(F.col("field") == "label").alias("a"), F.count_if(F.col("field") == "summary").alias("b"))
    asked = v.benchmark.select("item_id", F.size(token_set(F.col("text"))).alias("n"))
    return counts.join(r.small(asked), "item_id").select("item_id", "doc_id", s.rounded(1 + s.DECISION_WEIGHT * F.col("a") / F.col("n") + s.ENTITY_WEIGHT * F.col("b") / F.col("n")).alias("factor"))


@query("SELECT id, CASE WHEN status = 'superseded' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM sessions WHERE status NOT IN ('replaced')")
def r8_supersede_penalty(v: Views) -> DataFrame:
    return v.sessions.filter("status <> 'replaced'").select("id", F.when(F.col("status") == "superseded", s.SUPERSEDED_FACTOR).otherwise(1.0).alias("factor"))


@query("SELECT s.id, n.successor FROM sessions s LEFT JOIN (SELECT to_session AS id, max(from_session) AS successor FROM edges WHERE kind = 'supersedes' GROUP BY 1) n USING (id) WHERE status = 'superseded'")
def r11_successors(v: Views) -> DataFrame:
    return r.successors(v.sessions.filter("status = 'superseded'").select("id"), v.edges, "id")


FACT_Q = "['stack', 'e7', 'nf1']"


@query(f"""WITH w AS (SELECT * FROM versions WHERE superseded_by IS NULL AND retired = 0 ORDER BY created_at DESC, id DESC LIMIT 500),
k AS (SELECT id, 3 * len(list_intersect({FACT_Q}, list_distinct({TOK.format('value')}))) + len(list_intersect({FACT_Q}, list_distinct({TOK.format('subject')}))) + len(list_intersect({FACT_Q}, list_distinct({TOK.format('predicate')}))) AS score FROM w)
SELECT id, score FROM k WHERE score > 0""")
def r12_fact_keyword(v: Views) -> DataFrame:
    """Over the newest 500 candidates, as the window of candidates is the operator's contract."""
    window = f.current(v.versions).orderBy(F.desc("created_at"), F.desc("id")).limit(500)
    asked = F.array(*(F.lit(x) for x in ("stack", "e7", "nf1")))
    return window.select("id", f.keyword_score(asked).alias("score")).filter("score > 0")


@query(KNN + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d WHERE label <> 3) SELECT query_id, vec_id, rank FROM t WHERE rank <= 8")
def r13_fact_semantic(v: Views) -> DataFrame:
    return r.nearest(v.embeddings.filter("label <> 3"), _asked(v), "vec_id", "query_id", 8, others=True).select("query_id", "vec_id", "rank")


@query(_bm25() + MERGED.replace("p IS NOT NULL AS in_primary, x IS NOT NULL AS in_secondary, CASE WHEN p IS NOT NULL THEN 0.5 + 0.5 * p / greatest(1, max(p) OVER (PARTITION BY item_id)) ELSE 0.5 * x / greatest(1, max(x) OVER (PARTITION BY item_id)) END", "CASE WHEN x IS NOT NULL THEN 0.5 + 0.5 * x / greatest(1, max(x) OVER (PARTITION BY item_id)) ELSE 0.5 * p / greatest(1, max(p) OVER (PARTITION BY item_id)) END") + " SELECT item_id, doc_id, floor(score * 1e4 + 0.5) / 1e4 AS score FROM h")
def r14_fact_hybrid(v: Views) -> DataFrame:
    """Facts band the semantic leg first."""
    kw, near = _legs(v)
    return r.hybrid(near, kw, "item_id", "doc_id").select("item_id", "doc_id", s.rounded(F.col("score")).alias("score"))


@query("SELECT subject, predicate, value, count(DISTINCT session_id) AS sessions, floor(least(2.0, 1 + log10(greatest(1, count(DISTINCT session_id)))) * 1e4 + 0.5) / 1e4 AS factor FROM facts GROUP BY 1, 2, 3")
def r15_corroboration(v: Views) -> DataFrame:
    return f.corroborated(v.facts)


@query("SELECT id, 0.0::DOUBLE AS score FROM versions WHERE superseded_by IS NULL AND retired = 0 AND subject = 'e11' ORDER BY created_at DESC, id DESC LIMIT 10")
def r16_structured_facts(v: Views) -> DataFrame:
    return f.current(v.versions).filter("subject = 'e11'").orderBy(F.desc("created_at"), F.desc("id")).limit(10).select("id", F.lit(0.0).alias("score"))


@query("""WITH e AS (SELECT DISTINCT entity FROM session_entities WHERE session_id IN ('s1', 's2', 's3', 's4', 's5')), a AS (SELECT * FROM versions WHERE superseded_by IS NULL AND retired = 0 AND confidence >= 0.7 AND subject IN (SELECT entity FROM e)),
c AS (SELECT subject, predicate, value, count(DISTINCT session_id) AS sessions FROM facts GROUP BY 1, 2, 3 HAVING count(DISTINCT session_id) >= 2),
b AS (SELECT a.*, sessions FROM a JOIN c USING (subject, predicate, value) QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY sessions DESC, confidence DESC, value, id) = 1)
SELECT id, subject, predicate, value, sessions FROM b ORDER BY sessions DESC, confidence DESC, id LIMIT 5""")
def r17_related_facts(v: Views) -> DataFrame:
    entities = v.session_entities.filter(F.col("session_id").isin("s1", "s2", "s3", "s4", "s5"))
    return f.related(v.versions, entities).select("id", "subject", "predicate", "value", "sessions")


@query("""WITH h AS (SELECT 'q' || (seq % 97) AS query_id, id AS session_id, row_number() OVER (PARTITION BY seq % 97 ORDER BY seq) AS rank FROM sessions), e AS (SELECT session_id, entity AS subject, row_number() OVER (PARTITION BY session_id ORDER BY entity DESC) AS position FROM session_entities),
s AS (SELECT query_id, subject, min((rank, position)) AS place FROM h JOIN e USING (session_id) WHERE rank <= 5 GROUP BY 1, 2), w AS (SELECT query_id, subject FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, subject) <= 8),
l AS (SELECT * FROM versions WHERE superseded_by IS NULL AND retired = 0 AND subject IN (SELECT subject FROM w) QUALIFY row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, id DESC) <= 2),
c AS (SELECT subject, predicate, value, count(DISTINCT session_id) AS sessions FROM facts GROUP BY 1, 2, 3 HAVING count(DISTINCT session_id) >= 2),
b AS (SELECT l.*, sessions FROM l JOIN c USING (subject, predicate, value) WHERE confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY sessions DESC, confidence DESC, value, id) = 1)
SELECT query_id, subject, predicate, value, sessions, row_number() OVER (PARTITION BY query_id ORDER BY sessions DESC, confidence DESC, id) AS rank FROM w JOIN b USING (subject) QUALIFY rank <= 5""")
def r17_for_hits(v: Views) -> DataFrame:
    """Facts beside the hits of 97 queries: the first hits' entities in order, eight at most, and two of each's newest facts."""
    k = F.col("seq") % 97
    hits = v.sessions.select(F.concat(F.lit("q"), k.cast("string")).alias("query_id"), F.col("id").alias("session_id"), F.row_number().over(Window.partitionBy(k).orderBy("seq")).alias("rank"))
    entities = v.session_entities.withColumn("position", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("entity"))))
    return f.related_to_hits(v.versions, hits, entities, "query_id", min_confidence=0.5, newest=2)


@query("""WITH q AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2) AS e FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], e) AS distance FROM embeddings, q) SELECT query_id, vec_id FROM d WHERE distance <= 1.0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) <= 2""")
def r18_related_exemplars(v: Views) -> DataFrame:
    """Queries lie between two vectors, as the single ones are far apart."""
    following = v.embeddings.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("b"))
    middle = F.zip_with("embedding", "b", lambda x, y: (x.cast("double") + y.cast("double")) / 2)
    asked = _asked(v).join(following, "query_id").select("query_id", middle.alias("embedding"))
    return r.nearest(v.embeddings, asked, "vec_id", "query_id", 2, digits=9).filter("distance <= 1.0").select("query_id", "vec_id")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT query_id, vec_id, label >= 8 AS negative, floor((list_distance(embedding::DOUBLE[], e::DOUBLE[]) + CASE WHEN vec_id % 7 = 0 THEN 0.05 ELSE 0 END + CASE WHEN label >= 8 THEN 0.1 ELSE 0 END) * 1e4 + 0.5) / 1e4 AS cost FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, vec_id, negative, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, vec_id) AS rank FROM c QUALIFY rank <= 10""")
def r19_code_search(v: Views) -> DataFrame:
    rows = v.embeddings.withColumn("negative", F.col("label") >= 8).withColumn("survived", F.when(F.col("vec_id") % 7 == 0, 0).otherwise(1))
    return r.code_search(rows, _asked(v), "query_id", "vec_id", 10).select("query_id", "vec_id", "negative", "cost", "rank")


@query("""WITH c AS (SELECT id, count(*) AS n FROM cited GROUP BY 1) SELECT s.id, floor((CASE WHEN x > 0 THEN x + 0.15 * ln(1 + coalesce(n, 0)) ELSE x END) * 1e4 + 0.5) / 1e4 AS score FROM (SELECT id, (seq % 4) / 4.0::DOUBLE AS x FROM sessions) s LEFT JOIN c USING (id)""")
def r20_citation_boosts(v: Views) -> DataFrame:
    counts = v.cited.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = v.sessions.select("id", (F.col("seq") % 4 / 4.0).alias("x")).join(counts, "id", "left")
    return rows.select("id", s.rounded(F.when(F.col("x") > 0, F.col("x") + 0.15 * F.log1p(F.coalesce("n", F.lit(0)).cast("double"))).otherwise(F.col("x"))).alias("score"))


@query("""SELECT doc_id, 3 * contains(lower(label), 'the')::INT + 2 * contains(lower(summary), 'and')::INT + contains(lower(body), 'licen')::INT + 5 * contains(lower(label), 'and the')::INT AS score FROM papers""")
def r22_substring_scorer(v: Views) -> DataFrame:
    has = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    return v.papers.select("doc_id", (3 * has("label", "the") + 2 * has("summary", "and") + has("body", "licen") + 5 * has("label", "and the")).alias("score"))


@query("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'licen') AS i FROM documents) SELECT doc_id, CASE WHEN i > 0 THEN (CASE WHEN greatest(1, i - 60) > 1 THEN '...' ELSE '' END) || substr(text, greatest(1, i - 60), 120) || (CASE WHEN greatest(1, i - 60) + 120 <= length(text) THEN '...' ELSE '' END) ELSE substr(text, 1, 120) END AS snippet FROM p""")
def r23_snippets(v: Views) -> DataFrame:
    return v.documents.select("doc_id", snippet(F.col("text"), F.instr(F.lower("text"), F.lit("licen"))).alias("snippet"))


@query("""WITH h AS (SELECT conversation_id, id, count(*)::DOUBLE AS score FROM queries_log l JOIN (SELECT DISTINCT returned_id AS rid FROM queries_log) ON rid = returned_id, LATERAL (SELECT returned_id AS id) GROUP BY 1, 2), used AS (SELECT DISTINCT conversation_id, id FROM cited),
m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score, id) AS i, count(*) OVER (PARTITION BY conversation_id) AS n FROM h), m2 AS (SELECT *, max(CASE WHEN i = n // 2 + 1 THEN score END) OVER (PARTITION BY conversation_id) AS mid FROM m),
e AS (SELECT m2.* FROM m2 ANTI JOIN used USING (conversation_id, id) WHERE score >= 1 AND score >= 0.5 * mid), b AS (SELECT conversation_id, count(DISTINCT id) AS u FROM used GROUP BY 1)
SELECT conversation_id, id, score, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, id) AS pick FROM e LEFT JOIN b USING (conversation_id) QUALIFY pick <= least(3, greatest(0, 10 - coalesce(u, 0)))""")
def f14_select_hits(v: Views) -> DataFrame:
    hits = v.queries_log.groupBy("conversation_id", F.col("returned_id").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return r.select_hits(hits, v.cited.select("conversation_id", "id").distinct(), "conversation_id", "id", 1.0, 0.5)


@query("SELECT id, status <> 'replaced' AS with_superseded, status NOT IN ('superseded', 'replaced') AS plain, workstream_id IN ('w1', 'w2') AS member FROM sessions")
def f2_visibility(v: Views) -> DataFrame:
    """which sessions a query sees, with and without superseded ones, and within workstreams."""
    st = F.col("status")
    return v.sessions.select("id", (st != "replaced").alias("with_superseded"), (~st.isin("superseded", "replaced")).alias("plain"), F.col("workstream_id").isin("w1", "w2").alias("member"))


@query("SELECT id FROM versions WHERE retired = 0 AND confidence >= 0.7 AND kind = 'decision'")
def f4_fact_acceptance(v: Views) -> DataFrame:
    return v.versions.filter(f.accepted(superseded=True, min_confidence=0.7, kind="decision")).select("id")
