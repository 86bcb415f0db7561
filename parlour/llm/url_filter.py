"""Operator 3 (native): URL filter. Host and path rules first, else a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Scale: a URL is judged by JVM expressions alone, in one pass without shuffle. The rules and the regression's
BUCKETS weights have a fixed size, whatever the number of URLs. The n-grams are
those of the whole host and path; the labelled table is bounded by ``LABELLED_ROWS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.llm.common import ascii_lower

BUCKETS = 4096  # hashed n-grams
SIZES = (3, 4, 5)
LABELLED_ROWS = 10_000  # of the labelled table, in the order of a hash of the URL, at most
THRESHOLD = 0.5
REGULARISATION = 0.001


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules as given.
RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

# A small labelled URL table: words of hosts that a text corpus does not want, and of ordinary ones, by subject.
UNWANTED = ("casino", "poker", "slots", "jackpot", "betting", "best-bets", "bet-now", "roulette", "blackjack", "gambling", "lottery", "win-prizes", "big-win", "spin-to-win",
            "pills", "buy-pills", "diet-pills", "pharmacy", "viagra", "cialis", "cheap-watches", "cheap-meds", "replica-bags", "payday-loans", "quick-cash", "fast-loans",
            "crypto-doubler", "xxx", "porn", "adult", "adult-chat", "adult-videos", "escort", "sex-dates", "hot-singles", "ads", "my-ads", "ads-serve", "adserver", "ad-network",
            "banner-ads", "click-ads", "clicktrack", "track-clicks", "tracking-pixel", "popunder", "affiliate-deals", "promo-codes", "free-spins", "free-money", "spam",
            "torrent-warez", "keygen-crack")
ORDINARY = ("library", "museum", "university", "school", "college", "lecture", "reading", "writing", "poetry", "novels", "books", "magazine", "news", "journal", "archive",
            "weather", "climate", "ocean", "river", "forest", "island", "mountain", "garden", "nature", "birds", "animals", "flowers", "earth", "planets", "astronomy",
            "science", "physics", "chemistry", "biology", "history", "geography", "philosophy", "language", "grammar", "mathematics", "statistics", "research", "thesis",
            "health", "hospital", "nursing", "therapy", "nutrition", "recipes", "cooking", "kitchen", "bakery", "restaurant", "coffee", "travel", "railway", "station",
            "airport", "harbor", "bridge", "castle", "village", "city", "council", "government", "law", "justice", "community", "family", "children", "parents", "friends",
            "music", "theater", "cinema", "dance", "painting", "drawing", "photography", "design", "fashion", "clothes", "leather", "carpenter", "engine", "software",
            "computer", "network", "database", "tools", "workshop", "farming", "weaving", "knitting", "sailing", "running", "football", "tennis", "sports", "athletics",
            "market", "bank", "insurance", "energy", "water", "housing", "rent", "jobs", "teaching", "learning", "another", "together", "north", "south", "father",
            "mother", "brother", "thought", "method", "author", "nation", "notion", "motion", "table", "stable", "winter", "summer", "morning", "evening", "stories")
SITES, FORMS = ("www.{w}.example.com", "m.{w}.example.net", "blog.{w}.example.com", "{w}.example.net", "{w}.example.org"), ("/", ".html", "")
PLACES = ("en", "de", "article")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): 1 for unwanted. Every word stands in every site and beside every path, so that neither the
    form nor the place decides."""
    rows = [(f"https://{site.format(w=w)}/{place}/{100 + i}{FORMS[(i + j) % 3]}", label)
            for label, names in ((1, UNWANTED), (0, ORDINARY)) for i, w in enumerate(names) for j, site in enumerate(SITES) for place in PLACES]
    return spark.createDataFrame(rows, "url string, label int")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. A rule fits its host and all
    subdomains if the path starts with the rule's; of equally long rules the first one holds."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest last, so that it is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of ``^host$path$``; a run of digits counts as 0."""
    s = F.concat(F.lit("^"), host, F.lit("$"), F.regexp_replace(F.lower(path), "[0-9]+", "0"), F.lit("$"))

    def of_size(n: int) -> Column:
        at = F.when(F.char_length(s) >= n, F.sequence(F.lit(1), F.char_length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(s, i, F.lit(n)))

    return F.concat(*map(of_size, SIZES))


@dataclass(frozen=True)
class UrlModel:
    hashing: HashingTF
    regression: LogisticRegressionModel | None  # None: one label only
    constant: float = 0.0


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = LABELLED_ROWS) -> UrlModel:
    """Logistic regression by Spark ML on at most ``rows`` labelled URLs. Null labels are left out; if only one
    label occurs, the model always gives that label; of an empty table nothing is blocked."""
    host, path = host_path(F.col(url_col))
    data = (labelled.filter(F.col(label_col).isNotNull()).orderBy(F.xxhash64(url_col), F.col(url_col)).limit(rows)
            .select(F.col(label_col).cast("double").alias("label"), grams(host, path).alias("grams")))
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True)
    kinds = [r[0] for r in data.select("label").distinct().collect()]  # 0 and 1
    if len(kinds) < 2:
        return UrlModel(hashing, None, float(kinds == [1.0]))
    regression = LogisticRegression(regParam=REGULARISATION, maxIter=40, standardization=False)
    return UrlModel(hashing, regression.fit(hashing.transform(data).select("label", "features").coalesce(1)))


def with_probability(rows: DataFrame, model: UrlModel, host: Column, path: Column) -> DataFrame:
    """``rows`` with ``score``, the probability of label 1."""
    if model.regression is None:
        return rows.withColumn("score", F.lit(model.constant))
    scored = model.regression.transform(model.hashing.transform(rows.withColumn("grams", grams(host, path))))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("grams", "features", "rawPrediction", "probability", "prediction")


def filter_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url",
                rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the method's probability of block; null where a rule decides).

    A null URL, or one without ``://``, has an empty host and path, no rule, and the method's verdict on these.
    Repeated rows get equal results; an empty table an empty result. Other columns are not read."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    rows = with_probability(rows, model, F.col("host"), F.col("path"))
    rows = rows.withColumn("score", F.when(F.col("rule").isNull(), F.col("score")))
    judged = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")
