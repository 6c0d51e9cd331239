"""URL filter: rules, and logistic regression where no rule fits.

A rule has a host and a path.  It fits its host and all subdomains of it when
the url's path begins with the rule's; the longest fitting rule decides.  Other
urls are judged by logistic regression on hashed character n-grams of host and
path, trained on a small table of labelled urls: a bounded draw of each verdict
from those that rules decide, so that a rare verdict is not missed; a drawn url
weighs as many as it stands for.

A url that is null or has no ``://`` has an empty host and path, which no rule
with a host fits.  Of two rules of one length the one listed first decides.
Urls are judged row by row, repeated ones alike.  When the labelled table lacks
one of the verdicts, the other one (``allow``, if it lacks both) holds for all
urls without a rule.  An empty table gives no rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gaugeworks.llm.base import prepare, query, share, table

#: Labelled urls drawn for training (their expected number), and hash buckets.
LABELLED, BUCKETS = 20_000, 1 << 14


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The number of the rule that decides, or null."""
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i].text))
    fits = [F.when(((host == rules[i].host) | F.endswith(host, F.lit("." + rules[i].host)))
                   & F.startswith(path, F.lit(rules[i].path)), F.lit(i)) for i in order]
    return F.coalesce(*fits, F.lit(None).cast("int"))


def _grams(text: Column, sizes: tuple[int, ...], mark: str) -> Column:
    """Character n-grams of a text between two marks, the part's name before each."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))),
                    lambda i: F.concat(F.lit(mark), F.substring(whole, i, n))) for n in sizes))


def _with_features(urls: DataFrame, buckets: int) -> DataFrame:
    grams = urls.withColumn("grams", F.concat(_grams(F.col("host"), (3, 4), "h"), _grams(F.col("path"), (2, 3), "p")))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features").transform(grams)


def learned_scores(urls: DataFrame, told: DataFrame, labelled: int = LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """``urls`` (host, path) with a ``blocked_score`` learned from those of ``told``
    (page_id, host, path, told), of which about ``labelled`` are drawn."""
    classes = {r["told"]: r["n"] for r in told.groupBy("told").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return urls.withColumn("blocked_score", F.lit(float(set(classes) == {"block"})))
    chance = {verdict: min(1.0, labelled / 2 / n) for verdict, n in classes.items()}
    chance = F.when(F.col("told") == "block", chance["block"]).otherwise(chance["allow"])
    drawn = told.filter(share(F.concat_ws(" ", "page_id", "host", "path")) < chance).select(
        "host", "path", (F.col("told") == "block").cast("double").alias("label"), (1 / chance).alias("stands_for"))
    model = LogisticRegression(maxIter=25, regParam=0.01, weightCol="stands_for").fit(_with_features(drawn, buckets))
    return model.transform(_with_features(urls, buckets)).withColumn("blocked_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: int = LABELLED,
          buckets: int = BUCKETS) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked_score) of every page (page_id, url)."""
    prepare(pages.sparkSession)
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parts.withColumn("nth", rule_of(F.col("host"), F.col("path"), rules))
    texts = F.array(*(F.lit(r.text) for r in rules))
    verdicts = F.array(*(F.lit(r.verdict) for r in rules))
    at = F.col("nth") + 1
    judged = ruled.withColumn("rule", F.try_element_at(texts, at)).withColumn("told", F.try_element_at(verdicts, at))

    scored = learned_scores(judged, judged.filter("told IS NOT NULL"), labelled, buckets)
    learned = F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("told", learned).alias("verdict"),
                         "blocked_score")


@query("op2_urlfilter")
def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
