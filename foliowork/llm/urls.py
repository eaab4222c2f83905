"""URL filters: domain and path rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained by Spark's own logistic regression from a small labelled table of URLs. Scoring is a column
expression: the n-grams of host and path are hashed to buckets and their coefficients are added up.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowork.llm.shared import ascii_lower, read

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Labelled URLs: hosts of unwanted sites and of ordinary ones, paths of unwanted pages and of ordinary ones. A URL is unwanted if
#: its host or its path is.
BLOCK_HOSTS = (
    "cheap-pills.com", "www.cheap-pills.example", "pills-online.biz", "best-pills-shop.info", "buy-cheap-meds.com", "cheap-meds.example.org",
    "spam-farm.com", "spam-farm.example", "link-farm.info", "seo-link-farm.biz", "www.content-farm.net", "spam-links.example.com",
    "casino-bonus.com", "free-casino.example", "win-big-casino.info", "poker-bonus.biz", "bet-now.example.net", "lottery-winner.info",
    "free-money-now.biz", "get-rich-quick.com", "payday-loans.info", "cheap-loans.example.org", "replica-watches.com", "fake-bags-shop.biz",
    "adult-cams.com", "xxx-videos.example", "porn-free.info", "hot-singles.biz", "torrent-warez.net", "crack-keygen.info",
    "free-download-crack.com", "click-here-now.biz", "doorway-pages.info", "malware-host.example", "best-bets.biz", "free-bets-today.info",
    "sports-bets.example.org", "casino-wins.biz", "win-casino.example", "adult-x-cams.info", "adult-xx.biz", "ads-server.biz", "ads-tracker.info",
    "click-track.example", "ad-tracking.example.net", "popup-ads.example.com",
)
ALLOW_HOSTS = (
    "www.example.com", "blog.example.org", "m.example.net", "news.site.org", "docs.library.edu", "en.encyclopedia.org", "www.university.edu",
    "city-council.gov", "museum.org", "science.journal.com", "weather.gov", "www.recipes.com", "gardening.example.org", "history.example.com",
    "www.therin.example.com", "blog.tionsh.example.org", "m.thered.example.com", "shand.example.net", "ingen.example.com", "www.atones.org",
    "blog.ouraine.com", "m.stilling.org", "books.publisher.com", "www.hospital.org", "open-data.gov", "support.software.com", "forum.cycling.org",
    "travel-notes.com", "photo.album.net", "music.school.edu", "school.district.org", "research-lab.edu", "www.bakery.com", "farmers-market.org",
    "web-hosting.com", "short-stories.com", "plain-text.org", "trail-maps.com", "hill-walks.edu", "green-fields.org", "railway-tracks.org", "hot-springs.com",
    "winter-sports.com", "adult-education.edu", "old-town-hostel.com",
)
BLOCK_PATHS = (
    "/casino/bonus", "/free-pills/", "/cheap-pills.html", "/buy-cheap-meds/now", "/xxx/videos/1", "/adult/cams", "/poker/free-bonus", "/seo/link-farm/",
    "/warez/crack-keygen", "/get-rich-quick", "/replica-watches/sale", "/payday-loans/apply",
)
ALLOW_PATHS = ("", "/", "/en/12/", "/fr/345", "/de/678.html", "/es/90", "/index.html", "/about", "/2024/05/article", "/2021/10/story-of-a-town", "/docs/guide/install", "/news/city/library-opens", "/recipes/bread.html")

BUCKETS = 4096
SIZES = (3, 4)
THRESHOLD = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: after the first `://`, up to `/ ? # end`, and on up to `? # end`; else both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*+)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return ascii_lower(host), path


def split_url(df: DataFrame, url_column: str = "url") -> DataFrame:
    """The frame with `host` and `path` (which replace columns of those names)."""
    host, path = parts(F.col(f"`{url_column}`").cast("string"))
    return df.withColumns({"host": host, "path": path})


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for domain, start, said in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, f"{domain}{start}").otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed buckets of the character n-grams of host and path, each marked with the part it comes from."""

    def grams(mark: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", path))
    return F.array_distinct(F.concat(*(grams(mark, text, n) for mark, text in marked for n in SIZES)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(host, path, label): every labelled host with every labelled path."""

    def marked(name: str, unwanted: tuple, ordinary: tuple) -> Column:
        return F.array(*(F.struct(F.lit(x).alias(name), F.lit(bad).alias(f"bad_{name}")) for xs, bad in ((unwanted, True), (ordinary, False)) for x in xs))

    hosts = spark.range(0, 1, 1, 1).select(F.inline(marked("host", BLOCK_HOSTS, ALLOW_HOSTS)))
    both = hosts.select("host", "bad_host", F.inline(marked("path", BLOCK_PATHS, ALLOW_PATHS)))
    return both.select("host", "path", (F.col("bad_host") | F.col("bad_path")).cast("double").alias("label"))


def train(labelled: DataFrame) -> tuple[float, list[float]]:
    """Intercept and one coefficient per bucket, from (host, path, label). Both labels weigh the same in all."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 1.0 / n.get(1.0, 1)).otherwise(1.0 / n.get(0.0, 1)) * sum(n.values())
    rows = labelled.coalesce(1).select("label", weight.alias("weight"), buckets(F.col("host"), F.col("path")).cast("array<string>").alias("grams")).cache()
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True).fit(rows)
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30, standardization=False).fit(counter.transform(rows))
    rows.unpersist()
    weights = [0.0] * BUCKETS
    for bucket, weight in zip(counter.vocabulary, model.coefficients, strict=True):
        weights[int(bucket)] = float(weight)
    return model.intercept, weights


def score(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Probability that a URL is unwanted: a sum of coefficients, in one expression with one constant array."""
    intercept, weights = model
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in weights)), ",").cast("array<double>")
    total = F.aggregate(buckets(host, path), F.lit(intercept), lambda acc, b: acc + F.get(table, b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def filter_urls(pages: DataFrame, url_column: str = "url", rules=RULES, model: tuple[float, list[float]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Judge every URL: the columns of `pages` with host, path, rule, score and verdict (allow or block).

    A rule decides where one fits, and the longest wins; elsewhere the model does. Null URLs and URLs without `://`
    have an empty host and path, fit no rule and are judged by the model's value for them. Repeated rows stay, new
    columns replace columns of their names, and an empty table gives no rows.
    """
    model = model or train(labelled_urls(pages.sparkSession))
    split = split_url(pages, url_column)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = split.withColumns({"rule": rule, "score": score(F.col("host"), F.col("path"), model)})
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(verdict, by_model))


def op3_url_filters(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op3_url_filters": op3_url_filters}
ORACLES: dict[str, str] = {}
