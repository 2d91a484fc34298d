import random
import re
from urllib.parse import unquote

from awardlens.llm import url_filter as op


def brute(url, entries):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    user, plain = host.split("@")[-1], unquote(path) or "/"
    plain_host = re.sub(r":[0-9]*$", "", user).rstrip(".")
    fits = []
    for h, p, v, r in entries:
        own, of = (host, path) if r else (plain_host, plain)
        if (own == h or own.endswith("." + h)) and of.startswith(p):
            fits.append((r, len(h) + len(p), h + p, v))
    return host, path, max(fits, default=None)


def urls():
    rnd = random.Random(2)
    hosts = ["a.com", "WWW.Example.com", "example.com", "xexample.com", "b.net", "net", "m.spam-farm.example.org", "com", "", "a.com.", "spam-farm.example.net", "u:p@Spam-Farm.example.net:8080", "spam-farm.example.org..", "example.com:80", "." .join("abc" * 60)]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/", "/EN/x", "//", "/en/?q", "?x=/en/", "#t", "/é ü"]
    made = [f"http://{h}{p}" for h in hosts for p in paths]
    return [None, "", "no scheme/en/", "x://y://z.com/en/", *made, *rnd.sample(made, 20)]


def test_judgements_match_brute_force(spark):
    listed = op.default_list(spark)
    entries = [(r.key.split("|")[1], r.key.split("|", 2)[2], r.verdict, r["rank"]) for r in listed.collect()]
    rows = [(i, u) for i, u in enumerate(urls())]
    got = {r.page_id: r for r in op.judged(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, best = brute(u, entries)
        r = got[i]
        assert (r.host, r.path) == (host, path)
        assert (r["rule"], r.verdict) == ((best[2], best[3]) if best else (None, "allow")), u


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = [(f"host{i}.org|/",) for i in range(3000)]
    lines = op.bloom_lines(spark.createDataFrame(keys, "key string").repartition(4))

    def passed(names):
        line, masks = op._bits(op._hash(names), len(lines))
        return ((lines[line] & masks) == masks).all(1)

    assert passed([k for (k,) in keys]).all()
    assert passed([f"other{i}.org|/" for i in range(20000)]).mean() < 0.05


def test_repeated_rows_empty_table_and_empty_list(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert op.judged(df, op.default_list(spark)).count() == 3
    assert op.judged(df.limit(0), op.default_list(spark)).count() == 0
    assert {r.verdict for r in op.judged(df, op.default_list(spark).limit(0)).collect()} == {"allow"}


def test_any_table_is_a_list_and_escapes_are_read(spark):
    table = spark.createDataFrame([("Bad.org", "/a b/", "block"), ("bad.org", "/a b/ok", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://x.bad.org/a%20b/1", "http://bad.org/a%20b/ok/2", "http://bad.org/a", "http://bad.org:1/%61 b/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [r.verdict for r in op.judged(df, op.listed(table)).orderBy("page_id").collect()] == ["block", "allow", "allow", "block"]


def test_frequent_urls_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(op, "FREQUENT", 5)
    rows = [(i, "https://a.spam.com/x") for i in range(40)] + [(100, "https://b.org/y"), (101, None), (102, "https://spam.com/z")]
    listed = op.listed_urls(spark, [("spam.com", "/", "block")])
    got = {r.page_id: r.verdict for r in op.judged(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert got == {**dict.fromkeys(range(40), "block"), 100: "allow", 101: "allow", 102: "block"}


def test_clashing_columns_are_not_read(spark):
    rows = [(1, "https://spam.com/x"), (2, "https://b.org/y")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"HOST": op.F.lit("h"), "a.b": op.F.lit(1), "salt": op.F.lit(2), "Rule": op.F.lit(3), "n": op.F.lit(4), "key": op.F.lit(5)})
    listed = op.listed_urls(spark, [("spam.com", "/", "block")])
    got = {r.page_id: (r.host, r.path, r.verdict) for r in op.judged(df, listed).collect()}
    assert got == {1: ("spam.com", "/x", "block"), 2: ("b.org", "/y", "allow")}
