import math

import pytest
from pyspark.sql import functions as F

URLS = [
    (1, "http://WWW.Example.NET/en/5?x=1#y"), (2, "https://example.net/de/"), (3, "http://notexample.net"), (4, "http://net/"), (5, "http://a.b.example.com/de/1"),
    (6, "http://example.com/DE/1"), (7, "http://x.org/fr/#z"), (8, "http://example.org/en/"), (9, "no scheme"), (10, None), (11, ""), (12, "://"), (13, "http://h?q=/a"), (14, "http://h#f"),
    (15, "ftp://É😀.test/ü/1"), (16, "http://best-casino-slots.example.com/en/3"), (17, "http://www.weather-maps.example.com/en/3"), (None, "http://x.org/fr/"), (2, "https://example.net/de/"),
    (18, "http://long.test/" + "ab😀/" * 20000), (19, "a://b://c/d"), (20, "http:///only/path"),
]
RULES = {"net/": ("net", "/", "block"), "example.net/en/": ("example.net", "/en/", "allow"), "example.com/de/": ("example.com", "/de/", "block"), "org/fr/": ("org", "/fr/", "allow")}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def ruled(host, path):
    fits = [(len(k), k) for k, (h, p, _) in RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1] if fits else None


def test_judged_urls_match_brute_force(spark):
    from pyspark.ml.feature import HashingTF
    from verdigris.llm import urls

    df = spark.createDataFrame(URLS, "page_id long, url string")
    for name in ("host", "path", "rule", "features", "probability", "rawPrediction", "prediction", "_grams", "_host_chars", "label", "score", "html"):
        df = df.withColumn(name, F.lit("x"))
    labelled = urls.labelled_urls(spark)
    got = urls.judge_urls(df, labelled).collect()
    assert len(got) == len(URLS)
    model, tf = urls.url_model(labelled), HashingTF(numFeatures=urls.FEATURES)
    weights = model.coefficients.toArray()
    by = {r.page_id: r for r in got}
    for page, url in URLS:
        r, (host, path) = by[page], parts(url)
        assert (r.host, r.path, r.rule) == (host, path, ruled(host, path))
        grams = {part + s[i : i + n] for part, s in (("h", f"^{host}$"), ("p", path)) for n in urls.GRAMS for i in range(len(s) - n + 1)}
        z = model.intercept + sum(weights[k] for k in {tf.indexOf(g) for g in grams})
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        want = RULES[r.rule][2] if r.rule else "block" if r.score >= 0.5 else "allow"
        assert r.verdict == want
    assert (by[16].verdict, by[17].verdict) == ("block", "allow")
    assert urls.judge_urls(df.limit(0), labelled).collect() == []


def test_held_out_names(spark):
    from verdigris.llm import urls

    labelled = urls.labelled_urls(spark)
    fold = F.pmod(F.crc32(F.regexp_extract("url", r"http://(?:www\.|m\.|blog\.)?([a-z-]+)\.", 1).cast("binary")), F.lit(4))
    held = labelled.filter(fold == 0)
    model = urls.url_model(labelled.filter(fold != 0)).setFeaturesCol("features")
    rows = model.transform(urls.hashed(held, "url", "features"))
    right = {r.blocked: r.share for r in rows.groupBy("blocked").agg(F.avg((F.col("prediction") == F.col("blocked")).cast("int")).alias("share")).collect()}
    assert right[0] >= 0.9 and right[1] >= 0.7


def test_rule_table_agrees_with_the_list(spark):
    from verdigris.llm import urls

    rows = spark.createDataFrame([(i, u) for i, u in enumerate(u for _, u in URLS if u)], "page_id long, url string")
    host, path = urls.host_and_path(F.col("url"))
    rows = rows.select(host.alias("host"), path.alias("path"))
    rules = spark.createDataFrame([(*r,) for r in urls.RULES], "host string, path string, verdict string")
    got = {(r.host, r.path): (r.rule, r.verdict) for r in urls.rule_from_table(rows, rules).collect()}
    rule, verdict = urls.rule_for(F.col("host"), F.col("path"), urls.RULES)
    want = {(r.host, r.path): (r.rule, r.verdict) for r in rows.select("host", "path", rule.alias("rule"), verdict.alias("verdict")).collect()}
    assert got == want and len(got) > 15
