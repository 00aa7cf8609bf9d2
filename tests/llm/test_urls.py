import numpy as np
from pyspark.sql import functions as F

from fathom.llm.urls import build_cascade, filter_urls, query_cascade, url_key

URLS = [
    (1, "http://spam-farm.example.org/a", "x"), (2, "https://www.Spam-Farm.example.org/a/?q=1#z", "x"), (3, "http://sub.spam-farm.example.org", "x"),
    (4, "http://notspam-farm.example.org/a", "x"), (5, None, "x"), (6, "", "x"), (7, "no url", "x"), (7, "no url", "x"), (8, "http://u:p@good.example.com:80/x.html", None), (9, "http://good.example.com/" + "y" * 20000, "x"),
]


def test_exact_over_universe():
    rng = np.random.default_rng(1)
    for n, share in ((20000, 0.1), (20000, 0.9), (50, 0.5), (1, 1.0), (10, 0.0), (0, 0.5)):
        h1, h2 = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        listed = rng.random(n) < share
        assert (query_cascade(build_cascade(h1, h2, listed), h1, h2) == listed).all()


def test_filter(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string, blocked string")
    want = {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    for kw in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 3}, {"shard_keys": 3}):
        out = filter_urls(df, **kw).collect()
        assert len(out) == len(URLS) and {r.page_id: r.blocked for r in out} == want
    assert filter_urls(df.limit(0)).count() == 0
    listed = spark.createDataFrame([("https://good.example.com/x", ), (None,), ("http://elsewhere.example",)], "u string")
    assert {r.page_id for r in filter_urls(df, listed=listed).filter("blocked").collect()} == {8}


def test_key(spark):
    df = spark.createDataFrame([("HTTP://WWW.A.example/B/?x#y",), ("//a.example:8080/B.html",), ("a",)], "u string")
    assert [r[0] for r in df.select(url_key(F.col("u"))).collect()] == ["a.example/B", "a.example/B", ""]
