"""Hosts without labels are judged by their domain or suffix."""

import duckdb
from pyspark.sql import functions as F

from codeloom.llm import url_filter
from codeloom.llm.oracles import ORACLES


def test_unlabelled_hosts_take_the_rate_of_the_level_above(spark):
    urls = [f"http://h{k % 6}.bad.zz/{k}" for k in range(300)] + [f"http://h{k % 6}.good.yy/{k}" for k in range(300, 600)]
    fresh = {1000: "http://new.bad.zz/x", 1001: "http://other.zz/x", 1002: "http://new.good.yy/x", 1003: "http://other.yy/x", 1004: "http://nowhere.xx/x", 1005: "http:///x"}
    pages = spark.createDataFrame([*enumerate(urls), *fresh.items()], "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(k, int(k >= 300), 0) for k in range(600)], "doc_id long, quality int, toxic int")
    got = {row["page_id"]: row["verdict"] for row in url_filter.op10(pages, labels).collect()}
    assert len(got) == 606 and [got[k] for k in sorted(fresh)] == ["block", "block", "allow", "allow", "allow", "allow"]
    outcomes = url_filter.page_outcomes(pages, labels)
    rows = {r["host"]: r for r in url_filter.reputation_of(spark.createDataFrame([("new.bad.zz",), ("h1.bad.zz",)], "host string"), outcomes).collect()}
    domain = {r["domain"]: r for r in url_filter.level_rates(outcomes)["domain"].collect()}["bad.zz"]
    own = {r["host"]: r for r in url_filter.host_reputation(outcomes).collect()}["h1.bad.zz"]
    k, m = url_filter.level_rates(outcomes)["host"].first()["k"], domain["up"]
    assert rows["new.bad.zz"]["n"] == 0 and abs(rows["new.bad.zz"]["bound"] - (m - url_filter.BOUND_SD * (m * (1 - m) / (k + 1)) ** 0.5)) < 1e-9
    assert abs(rows["h1.bad.zz"]["bound"] - own["bound"]) < 1e-9


def test_ports_users_addresses_and_two_label_suffixes(spark):
    hosts = ["shop.co.uk", "u@www.bbc.co.uk:8080", "192.168.7.9:80", "a.b.example.com.", "com", "x.org:"]
    sites = url_filter.with_levels(spark.createDataFrame([(h,) for h in hosts], "host string").select(url_filter.site_of(F.col("host")).alias("host")))
    assert [tuple(row) for row in sites.collect()] == [("shop.co.uk", "shop.co.uk", "co.uk"), ("www.bbc.co.uk", "bbc.co.uk", "co.uk"), ("192.168.7.9",) * 3, ("a.b.example.com", "example.com", "com"), ("com",) * 3, ("x.org", "x.org", "org")]


def test_verdicts_match_sql_with_ports_unlabelled_hosts_and_odd_rows(spark, tmp_path):
    names = ["bad.co.uk", "a.bad.co.uk:8080", "good.co.uk", "10.0.0.1", "10.0.0.1:99", "fine.org", "u@evil.zz", "evil.zz", "sub.evil.zz", "x.net"]
    urls = [f"http://{names[k % 10].upper() if k % 7 == 0 else names[k % 10]}/p/{k}" for k in range(2000)] + [f"http://new{k}.evil.zz/none" for k in range(50)] + [None, "", "x", "http:///1", "http://bad.co.uk/" + "y" * 50_000 + "7"]
    bad = lambda k: k % 10 in (0, 1, 3, 4, 6, 7) and k % 11
    spark.createDataFrame([*((k, u, "clash", 1, 1.0) for k, u in enumerate(urls)), (None, "http://evil.zz/3", "", 1, 1.0), (5, urls[5], "", 1, 1.0)], "page_id long, url string, host string, n int, bound double").repartition(5).write.parquet(f"{tmp_path}/pages")
    spark.createDataFrame([(k, int(not bad(k)), 0, "x") for k in range(0, 2000, 2)] + [(1, None, 1, "x"), (4, 1, 1, "x"), (None, 0, 0, "x")], "doc_id long, quality int, toxic int, host string").write.parquet(f"{tmp_path}/labels")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    pages, labels = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("pages", "labels"))
    outcomes = url_filter.page_outcomes(pages, labels)
    for got in (url_filter.op10(pages, labels), url_filter.filter_urls(pages, outcomes, broadcast_hosts=-1)):
        expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op10_url_filter']})").fetchall()
        assert sorted(map(str, expected)) == sorted(str(tuple(row)) for row in got.collect())
        assert 200 < sum(row[-1] == "block" for row in expected) < 1900
