"""URL filters: rules on host and path, and for all other urls a logistic regression on hashed character n-grams.

Columns and Spark's own ML only: n-grams of host and path are arrays of strings, hashed to vectors of fixed size.

Host: after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased. Path: from there up to `?`, `#` or the
end. A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule (host and path
together) wins, then the one with the longer host, then the first by name.

Cases: a null url, and one without `://`, has an empty host and path, fits no rule, and gets the model's verdict on no
n-grams; very long urls are cut into n-grams like any other; repeated rows each get a row; columns of other names are left
behind; an empty table gives no rows; without both labels the model allows everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

BLOCKED = """casino.example/slots/free-spins bet-now.example/odds/live poker-bonus.example/join cheap-pills.example/buy/order
adult-cams.example/live/room xxx-videos.example/watch warez.example/crack/keygen torrent-hub.example/download/movie
free-iphone.example/win/prize loan-fast.example/apply/instant click.example/redirect/aff ads.example/banner/popup
track.example/pixel/click phish-login.example/verify/account malware.example/setup.exe replica-watches.example/buy
dating-hot.example/chat/girls crypto-double.example/invest/now seo-links.example/buy/backlinks spam.example/unsubscribe
slots.example/jackpot/bonus free-download.example/crack.exe lottery-win.example/claim pills.example/discount/order""".split()
ALLOWED = """www.example.org/en/article docs.example.org/guide/intro blog.example.com/2020/05/post news.example.net/world/story
wiki.example.org/page/history www.example.edu/research/paper library.example.org/books/catalog m.example.com/en/1204
www.example.net/de/2210 science.example.org/physics/notes museum.example.org/collection recipes.example.com/soup/leek
shop.example.com/products/chair forum.example.net/thread/881 www.example.com/fr/3310 gov.example.org/law/act
health.example.org/advice/sleep travel.example.com/cities/lyon sports.example.net/results music.example.org/scores/bach
code.example.org/src/readme weather.example.net/today www.example.org/es/99201 archive.example.org/1999/issue""".split()


@dataclass(frozen=True)
class UrlParams:
    orders: tuple[int, ...] = (3, 4)
    buckets: int = 1 << 14
    threshold: float = 0.5
    max_iter: int = 40
    ridge: float = 0.01
    #: Rules up to this number are one constant; more are joined by host.
    inline_rules: int = 200


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("https://" + u, 1) for u in BLOCKED] + [("https://" + u, 0) for u in ALLOWED], "url string, label int")


def _grams(p: UrlParams) -> Column:
    """n-grams of each part between marks, so that a part's place in the url doesn't matter."""
    marked = [F.concat(F.lit(mark), c, F.lit("$")) for mark, c in (("h:", F.col("host")), ("p:", F.col("path")))]

    def grams(c: Column, n: int) -> Column:
        return F.when(F.length(c) > n + 2, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, n)))

    each = [grams(c, n) for c in marked for n in p.orders]
    return F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in each))


def train(labelled: DataFrame, p: UrlParams = UrlParams()):
    """A logistic regression from a small table (url, label), or None without both labels."""
    rows = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")).filter("label is not null")
    if rows.select("label").distinct().count() < 2:
        return None
    rows = _hashed(p).transform(rows.withColumn("_grams", _grams(p)))
    return LogisticRegression(featuresCol="_features", labelCol="label", maxIter=p.max_iter, regParam=p.ridge, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted").fit(rows)


def _hashed(p: UrlParams) -> HashingTF:
    return HashingTF(numFeatures=p.buckets, binary=True, inputCol="_grams", outputCol="_features")


def longest_rule(pages: DataFrame, rules: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """`pages` (with host and path) with `_rule`, a struct (n, host length, rule, verdict), or null."""
    rules = rules.filter("host is not null and path is not null").select("host", "path", "verdict").distinct()
    got = rules.limit(p.inline_rules + 1).collect()
    size = lambda host, path: F.length(host) + F.length(path)
    as_struct = lambda host, path, verdict: F.struct(size(host, path).alias("n"), F.length(host).alias("h"), F.concat(host, path).alias("rule"), verdict.alias("verdict"))
    if len(got) <= p.inline_rules:
        each = [F.when((F.col("host") == r.host) | F.col("host").endswith("." + r.host), F.when(F.col("path").startswith(r.path), as_struct(F.lit(r.host), F.lit(r.path), F.lit(r.verdict)))) for r in sorted(got, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.host + r.path, r.verdict))]
        return pages.withColumn("_rule", F.coalesce(*each) if each else F.lit(None).cast("struct<n:int,h:int,rule:string,verdict:string>"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = pages.select("host", "path").distinct()
    hits = hosts.withColumn("_host", F.explode(suffixes)).join(rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict")), "_host")
    hits = hits.filter(F.col("path").startswith(F.col("_path"))).select("host", "path", as_struct(F.col("_host"), F.col("_path"), F.col("_verdict")).alias("r"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.col("r.n")).alias("a"), (-F.col("r.h")).alias("b"), F.col("r.rule").alias("c"), F.col("r.verdict").alias("d"), F.col("r").alias("r")))["r"].alias("_rule"))
    return pages.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: DataFrame, p: UrlParams = UrlParams(), key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, score): score is the model's probability of `block`."""
    model = train(labelled, p)
    rows = pages.select(key, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = longest_rule(rows, rules, p)
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = model.transform(_hashed(p).transform(rows.withColumn("_grams", _grams(p)))).withColumn("score", vector_to_array("_probability")[1])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= p.threshold, "block").otherwise("allow"))
    return rows.select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")
