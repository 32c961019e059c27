import re

from pyspark.sql import functions as F

from docspark.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
URLS = [
    "http://a.example.org/es/1", "http://example.org/es", "https://EXAMPLE.org/es/?q", "http://notexample.org/es/x", "http://x.com/fr/1",
    "http://x.com/de/1#a", "http://x.com/DE/1", "ftp://x.net", "x.com/de/1", "", None, "http://", "a://b://c.com/de/", "http://com/de/",
    "http://Ünï.com/de/é", "http://x.com?/de/", "http://u:p@x.com:80/de/", "http://www.spam.net/a.html", "https://spam.net/a/?x=1#y",
    "http://m.spam.net/a", "http://spam.net/b", "http://other.net/a", "http://x.com\n/de/",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in RULES:
        name, _, rest = rule.partition("/")
        if ("." + host).endswith("." + name) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def canonical(host, path):
    return re.sub(r"^(www|m)\.", "", host) + re.sub("/+$", "", re.sub(r"\.html?$", "", path))


def judged(spark, listed, blocks, url_list=URLS):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(url_list)], "page_id long, url string, canonical string")
    table = spark.createDataFrame([(u,) for u in listed], "canonical string")
    return {r["page_id"]: r.asDict() for r in urls.judge(pages, table, RULES, blocks).collect()}


def test_verdicts_match_plain_python(spark):
    listed = ["spam.net/a", "never.seen/x"]
    for blocks in (1, 64, urls.MAX_BLOCKS):  # a tiny filter lets everything pass, the join still decides
        got = judged(spark, listed, blocks)
        assert len(got) == len(URLS)
        for i, url in enumerate(URLS):
            host, path, best = plain(url)
            hit = canonical(host, path) in listed
            want = best[1] if best else "block" if hit else "allow"
            assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0], want), url
            assert got[i]["listed"] == hit


def test_hot_url_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(None if i % 50 == 0 else i % 9, "http://spam.net/a") for i in range(500)], "page_id long, url string")
    table = spark.createDataFrame([("spam.net/a",)], "canonical string")
    rows = urls.judge(pages, table, RULES).collect()
    assert len(rows) == 500 and all(r["verdict"] == "block" for r in rows)


def test_filter_has_no_false_negative(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    sieve = urls.bloom(listed, F.xxhash64("canonical"), 512)
    assert sieve.count() <= 512
    rows = listed.withColumn("salt", F.lit(0))
    assert urls.in_list(rows, listed, 512).where("not listed").count() == 0


def test_empty_list_and_empty_table(spark):
    got = judged(spark, [], 64)
    assert not any(r["listed"] for r in got.values())
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame([("a",)], "canonical string"), RULES).count() == 0


def test_equal_lengths_take_the_first_rule(spark):
    pages = spark.createDataFrame([(1, "http://a.bc/d/e")], "page_id long, url string")
    found, _ = urls.rule_of(urls.host(F.col("url")), urls.path(F.col("url")), [("bc/d/e", "x"), ("a.bc/d", "y")])
    assert pages.select(found).first()[0] == "a.bc/d"


def test_very_long_urls(spark):
    long = "http://a.x.com/fr/" + "é/" * 100_000 + "?q#" + "z" * 1000
    got = judged(spark, [canonical(*plain(long)[:2])], 64, [long, long.replace("/fr/", "/xx/")])
    assert got[0]["path"] == plain(long)[1] and got[0]["rule"] == "com/fr/" and got[0]["listed"] and not got[1]["listed"]
