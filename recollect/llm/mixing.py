"""Mixing sources to target weights, by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked to target marginals of the
three in turn, round by round, and a document is kept with its cell's calibrated probability: the raked weight over the
cell's own tokens, times a factor that brings the expected tokens to `keep` of all, clipped at 1. The factor is solved exactly: cells are
sorted by their ratio of weight to tokens, and those before some place are kept whole; if all cells with weight don't hold enough tokens, they are all
kept, with a warning. Whether a document is kept depends on a hash of its id only. Column expressions only: the texts are
summed to cells before the shuffle, and all rounds work on the cells, up to `together` of them in one task without a shuffle.

Rounds end when every marginal is met within `tolerance`. Where no weights meet them all (a cell that has no document can't
get any), they end after `rounds`, with a warning that says how far off the worst one is, or with an error if `strict`.

Targets are by default each value's share of tokens to the power `temper`, scaled to 1; or a table (value, share). Topics
are a column of your own, or by default a coarse one from marks in the text.

Cases: a null source, language or topic of your own is a value of its own (''), and so is a null text's topic (`none`); a document without
a word has weight 0, and its cell's probability if the cell has tokens, else 0; a null id hashes as the empty text;
repeated rows are kept or dropped alike; very long texts are counted where they are read;
columns of the names that are added are replaced; an empty table gives no rows; values without a target share are not kept.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written

DIMENSIONS = ("m_source", "m_lang", "m_topic")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    temper: float = 0.7
    keep: float = 0.5
    rounds: int = 60
    #: Largest miss of a marginal, as a share of all tokens.
    tolerance: float = 1e-10
    strict: bool = False
    #: Cells that one task rakes; more are shuffled by each dimension in turn.
    together: int = 500_000
    #: Rounds between two tables, to keep plans short and to see whether marginals are met.
    cut: int = 5


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the whole text; pass a column of your own for another."""
    return (
        F.when(text.isNull(), "none").when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit("icense")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table").when(text.rlike("[0-9][0-9][0-9]"), "numeric").otherwise("prose")
    )


def featured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    text = F.col("text")
    return docs.withColumns({
        "m_source": F.coalesce("source", F.lit("")), "m_lang": F.coalesce("lang", F.lit("")), "m_topic": topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("")),
        "m_tokens": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
    })


def probabilities(rows: DataFrame, p: MixParams = MixParams(), targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(source, language, topic, tokens, weight, p) of each cell of rows from `featured`."""
    first = written(rows.groupBy(*DIMENSIONS).agg(F.sum("m_tokens").alias("t")).filter("t > 0"), "cells")
    n, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("t"), F.lit(0)).cast("double")).first()
    held = (lambda df: df.coalesce(1)) if n <= p.together else (lambda df: df)  # in one task windows need no shuffle
    cells = held(first).withColumn("all", F.lit(total)).withColumn("w", F.col("t") / F.lit(total or 1.0))
    for d in DIMENSIONS:
        if targets and d in targets:
            shares = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias(f"g_{d}"))
        else:
            powers = first.groupBy(d).agg(F.pow(F.sum("t") / F.lit(total or 1.0), F.lit(p.temper)).alias("q"))
            scale = powers.agg(F.sum("q")).first()[0] or 1.0
            shares = powers.select(d, (F.col("q") / F.lit(scale)).alias(f"g_{d}"))
        cells = cells.join(shares, d)
    cells, k, miss = written(cells, "cells"), 0, 1.0
    dropped(first)
    while k < p.rounds and miss > p.tolerance:
        before, now = cells, held(cells)
        for _ in range(p.cut):
            for d in DIMENSIONS:
                now = now.withColumn("w", F.col("w") * F.col(f"g_{d}") / F.sum("w").over(Window.partitionBy(d)))
        cells, k = written(now, "cells"), k + p.cut
        dropped(before)
        off = [F.abs(F.sum("w").over(Window.partitionBy(d)) - F.col(f"g_{d}")).alias(f"o_{d}") for d in DIMENSIONS]
        miss = max(held(cells).select(*off).agg(*(F.coalesce(F.max(f"o_{d}"), F.lit(0.0)) for d in DIMENSIONS)).first())
    if miss > p.tolerance:
        said = f"marginals are missed by up to {miss:.3g} after {k} rounds"
        if p.strict:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    c = _factor(cells.filter("w > 0").withColumn("r", F.col("w") * F.col("all") / F.col("t")), p.keep * total)
    chance_of = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("w") * F.col("all") / F.col("t"))).otherwise(0.0)
    out = written(cells.select(*DIMENSIONS, "t", "w", chance_of.alias("p")), "cells")
    dropped(cells)
    return out


def _factor(cells: DataFrame, wanted: float) -> float:
    """The c for which the sum of min(1, c r) t is `wanted`: with cells in descending order of r, the first place where those before it, kept whole,
    and the rest at c give so many tokens and c r is at most 1 for the rest."""
    order = Window.orderBy(F.desc("r"), *DIMENSIONS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.asc("r"), *(F.desc(d) for d in DIMENSIONS)).rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select("r", ((F.lit(wanted) - F.coalesce(F.sum("t").over(before), F.lit(0))) / F.sum(F.col("r") * F.col("t")).over(rest)).alias("c"), *DIMENSIONS)
    found = rows.filter(F.col("c") * F.col("r") <= 1).agg(F.min_by("c", F.struct(-F.col("r"), *DIMENSIONS))).first()[0]
    if found is None:
        if cells.limit(1).count():
            warnings.warn("all documents of cells with a weight are kept, and don't hold as many tokens as are wanted", stacklevel=3)
        return float("inf")
    return max(0.0, float(found))


def chance(key: str) -> Column:
    """Between 0 and 1, from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, p: MixParams = MixParams(), topic: Column | None = None, targets: dict[str, DataFrame] | None = None, key: str = "doc_id") -> DataFrame:
    """`docs` with m_source, m_lang, m_topic, m_tokens, m_p and m_kept."""
    rows = featured(docs.drop("m_p", "m_kept"), topic)
    cells = probabilities(rows, p, targets).select(*DIMENSIONS, F.col("p").alias("m_p"))
    out = rows.join(cells, list(DIMENSIONS), "left").withColumn("m_p", F.coalesce("m_p", F.lit(0.0)))
    return out.withColumn("m_kept", chance(key) < F.col("m_p"))


def oracle(p: MixParams = MixParams()) -> str:
    """The same in DuckDB SQL, for the default topics and targets."""
    parts = [
        f"""f AS (SELECT doc_id, coalesce(source, '') AS m_source, coalesce(lang, '') AS m_lang,
  CASE WHEN text IS NULL THEN 'none' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, 'icense') THEN 'legal'
    WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[0-9][0-9][0-9]') THEN 'numeric' ELSE 'prose' END AS m_topic,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS m_tokens FROM documents)""",
        "c0 AS (SELECT m_source, m_lang, m_topic, sum(m_tokens)::BIGINT AS t FROM f GROUP BY ALL HAVING sum(m_tokens) > 0)",
        "tot AS (SELECT sum(t)::DOUBLE AS n FROM c0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"q_{d} AS (SELECT {d}, pow(sum(t) / any_value(n), {p.temper}::DOUBLE) AS q FROM c0, tot GROUP BY {d})")
        parts.append(f"g_{d} AS (SELECT {d}, q / (SELECT sum(q) FROM q_{d}) AS g FROM q_{d})")
    cells = ", ".join(f"g_{d}.g AS g_{d}" for d in DIMENSIONS)
    joins = " ".join(f"JOIN g_{d} USING ({d})" for d in DIMENSIONS)
    names = "m_source, m_lang, m_topic, t, " + ", ".join(f"g_{d}" for d in DIMENSIONS)
    inner = f"SELECT k + 1 AS k, {names}, w * g_m_source / sum(w) OVER (PARTITION BY m_source) AS w FROM r WHERE k < {p.rounds}"
    for d in DIMENSIONS[1:]:
        inner = f"SELECT k, {names}, w * g_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM ({inner})"
    parts.append(f"r AS (SELECT 0 AS k, m_source, m_lang, m_topic, t, {cells}, t / n AS w FROM c0 {joins}, tot UNION ALL {inner})")
    parts.append(f"k0 AS (SELECT r.*, w * n / t AS r, n FROM r, tot WHERE k = {p.rounds})")
    parts.append(f"""c0s AS (SELECT r, m_source, m_lang, m_topic, ({p.keep}::DOUBLE * n - coalesce(sum(t) OVER (ORDER BY r DESC, m_source, m_lang, m_topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(r * t) OVER (ORDER BY r, m_source DESC, m_lang DESC, m_topic DESC ROWS UNBOUNDED PRECEDING) AS c FROM k0)""")
    parts.append("s AS (SELECT coalesce(arg_min(c, (-r, m_source, m_lang, m_topic)), 1e300) AS c FROM c0s WHERE c * r <= 1)")
    parts.append("cells AS (SELECT m_source, m_lang, m_topic, least(1.0, c * r) AS p FROM k0, s)")
    return "WITH RECURSIVE " + ",\n".join(parts) + """
SELECT doc_id, m_source, m_lang, m_topic, m_tokens, floor(coalesce(p, 0) * 1e6 + 0.5) / 1e6 AS m_p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < coalesce(p, 0) AS m_kept
FROM f LEFT JOIN cells USING (m_source, m_lang, m_topic)
"""
