"""URL filters: rules on hosts and paths, and logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Lengths of the n-grams, hashed features (2^16 doubles are sent to the tasks), and the least score that blocks.
GRAMS, FEATURES, THRESHOLD = (3, 4, 5), 1 << 16, 0.5
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The small labelled table, stated as text: site names of either kind, each of which comes with every ending and path,
#: so that these say nothing by themselves.
BLOCKED = """
casino royal-casino casino-online best-casino winner-casino slots win-slots poker-win bingo-win jackpot-win lottery-win win-money free-spins free-money free-casino bets live-bets bets-today sport-bets betting free-betting
pills diet-pills pills-shop cheap-meds cheap-watches cheap-viagra cheap-loans viagra adult adult-chat adult-videos adult-dating porn porn-tube xxx xxx-adult sex-cams
spam spam-mail spam-links spamfarm link-farm content-farm click-farm farm-links ads ads-server popup-ads ad-tracker track track-click tracking-ads click-track
""".split()
ALLOWED = """
library gardening weather citynews university software history travelling museum recipes photography hospital school reading theatre archive journal maps region thinking station nation orchestra weaving books
council sharing forest mother another housing together father brother teaching learning science physics chemistry biology mathematics music painting sculpture poetry novels letters essays railway airport harbour river
mountain island village market bakery kitchen garden farmers cheapness freedom winter adulthood betterment tracks window
health doctor nurse clinic pharmacy court lawyer police justice parliament election budget economy finance bank insurance
software-docs open-data user-guide help-desk bike-repair book-shop city-hall home-page day-care road-map blue-sky tea-house
thought then others thanks there north south earth strength weather-station the-times other-nation
""".split()
ENDINGS = ("{}.test", "www.{}.example.test", "m.{}.example.test", "blog.{}.test")
PATHS = ("/en/1", "/de/25.html", "/fr/360/", "/es/4?page=2&ref=x", "/en/571#top", "/")


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (ASCII letters in lower case) and the path; both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), LETTERS, LETTERS.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest of ``rules`` that fits (of equally long ones the first by name), or nulls. Each
    rule costs a comparison a row and no shuffle; for a table of rules there is ``rule_from_table``."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def rule_from_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``urls`` (host, path) with the rule and verdict of the longest fitting row of ``rules`` (host, path,
    verdict), if any. A host meets rules by its own domain suffixes, as many as it has labels, so work follows the URLs
    and not URLs times rules; the planner splits suffixes that hold much of the table."""
    urls = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    held = rules.select(F.col("host").alias("end"), F.col("path").alias("start"), "verdict")
    hits = urls.withColumn("end", F.explode(ends)).join(held, "end").filter(F.col("path").startswith(F.col("start")))
    rule = F.concat("end", "start")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", "best.rule", "best.verdict")


def with_grams(rows: DataFrame, host: Column, path: Column, grams: str) -> DataFrame:
    """``rows`` with all n-grams of the host between ``^`` and ``$`` and of the path, each under its part's letter.
    Characters are split once, so a URL of any length costs as much as it is long."""
    h, p = fresh(rows.columns, "_host_chars", "_path_chars")
    rows = rows.withColumn(h, F.split(F.concat(F.lit("^"), host, F.lit("$")), "")).withColumn(p, F.split(path, ""))

    def of(chars: str, part: str, n: int) -> Column:
        return F.transform(F.col(chars), lambda x, i: F.concat(F.lit(part), x, *[F.get(F.col(chars), i + j) for j in range(1, n)]))

    return rows.withColumn(grams, F.array_compact(F.concat(*[of(c, part, n) for c, part in ((h, "h"), (p, "p")) for n in GRAMS]))).drop(h, p)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: url and blocked (0 or 1)."""
    rows = [(f"http://{end.format(name)}{path}", blocked) for names, blocked in ((BLOCKED, 1), (ALLOWED, 0)) for name in names for end in ENDINGS for path in PATHS]
    return spark.createDataFrame(rows, "url string, blocked int")


def hashed(rows: DataFrame, url: str, features: str) -> DataFrame:
    (grams,) = fresh([*rows.columns, features], "_grams")
    rows = with_grams(rows, *host_and_path(F.col(f"`{url}`")), grams)
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol=grams, outputCol=features).transform(rows).drop(grams)


def url_model(labelled: DataFrame) -> LogisticRegressionModel:
    """Logistic regression on a small table ``labelled`` (url, blocked), read in one partition so that sums have one order."""
    rows = hashed(labelled.select("url", F.col("blocked").cast("double").alias("label")).coalesce(1), "url", "features")
    return LogisticRegression(maxIter=100, regParam=0.01, standardization=False).fit(rows.select("features", "label"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every row of ``pages``, without a shuffle.

    ``verdict`` is the longest fitting rule's, else block where the model's score is at least ``threshold``. Null URLs
    and those without ``://`` have an empty host and path, fit no rule and get the score of a URL without a known
    n-gram. Page ids are passed through, null or not; repeated rows give repeated rows and an empty table none; other
    columns are not read.
    """
    model = url_model(labelled).setFeaturesCol("features")
    rows = hashed(pages.select("page_id", "url"), "url", "features")
    rows = model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "score")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
