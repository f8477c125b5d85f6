import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls as U

# by topic: what is no web address, hosts, ports, paths, queries
IDENTITIES = [
    (" ", None),
    ("gopher://lake.test/1", None),
    ("data:text/plain,hi", None),
    ("https://lake.test:70000/", None),
    ("https://two words.test/", None),
    ("lake.test/shore", "https://lake.test/shore"),
    ("HTTP://Lake.TEST", "http://lake.test/"),
    ("https://www.lake.test/Pier", "https://lake.test/Pier"),
    ("https://anna:pw@lake.test/in", "https://anna:pw@lake.test/in"),
    ("http://lake.test:443/x", "http://lake.test:443/x"),
    ("https://lake.test:00443/x", "https://lake.test/x"),
    ("http://lake.test:80", "http://lake.test/"),
    ("https://lake.test/a//b/", "https://lake.test/a//b"),
    ("https://lake.test/one/two/../../three/.", "https://lake.test/three"),
    ("https://lake.test/wide space/\u00f8", "https://lake.test/wide%20space/%C3%B8"),
    ("https://lake.test/boats?", "https://lake.test/boats"),
    ("https://lake.test/boats?size=9&kind=row&age=3", "https://lake.test/boats?age=3&kind=row&size=9"),
    ("https://lake.test/boats?tag=z&tag=b", "https://lake.test/boats?tag=b&tag=z"),
    ("https://lake.test/boats?utm_term=q&_ga=7&kind=row", "https://lake.test/boats?kind=row"),
    ("https://lake.test/find?w=%D0%B2%D0%B0%D0%BB", "https://lake.test/find?w=%D0%B2%D0%B0%D0%BB"),
    ("https://lake.test/boats#list", "https://lake.test/boats"),
    ("https://S\u00e6.Test/", "https://xn--s-4fa.test/"),
    ("https://xn--S-4fa.test", "https://xn--s-4fa.test/"),
    ("https://la%6Be.test/x", "https://lake.test/x"),
    ("https://s%C3%A6.test/", "https://xn--s-4fa.test/"),
    ("https://lake%20.test/", None),
    ("http://10.1", "http://10.0.0.1/"),
    ("http://0x0A.0.01.7/a", "http://10.0.1.7/a"),
    ("http://167772161", "http://10.0.0.1/"),
    ("http://10.0.0.300/", None),
    ("http://1.2.3.4.5/", None),
    ("http://lake.7/", None),
]


def normalized(spark, urls, **options):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r.n for r in U.normalize_url(df, "u", "n", **options).orderBy("i").collect()]


def test_identity_keys(spark):
    got = normalized(spark, [u for u, _ in IDENTITIES])
    assert [g and g.identity_key for g in got] == [k for _, k in IDENTITIES]


def test_parts(spark):
    (n,) = normalized(spark, ["http://WWW.Lake.test:8081/map#north-east"])
    assert (n.identity_key, n.url, n.fragment) == ("http://lake.test:8081/map", "http://lake.test:8081/map#north-east", "north-east")
    assert (n.host, n.normalized_host, n.port, n.origin) == ("www.lake.test", "lake.test", "8081", "http://lake.test:8081")


def test_options(spark):
    keys = lambda urls, **kw: [n.identity_key for n in normalized(spark, urls, **kw)]
    assert keys(["https://www.lake.test/x"], drop_www=False) == ["https://www.lake.test/x"]
    assert keys(["http://lake.test/x", "http://lake.test:8081/x"], force_https=True) == ["https://lake.test/x", "http://lake.test:8081/x"]
    assert keys(["https://lake.test/x?Crew=4&kind=row"], blacklist=("crew",)) == ["https://lake.test/x?kind=row"]


SCOPES = [
    ("same_domain", [], {"lake.test": True, "api.lake.test": False}),
    ("same_site", [], {"lake.test": True, "api.lake.test": True, "mylake.test": False}),
    ("allowlist", ["dock.test", "*.FERRY.test", ".buoy.test"], {"dock.test": True, "a.dock.test": False, "a.ferry.test": True, "ferry.test": False, "buoy.test": True}),
    ("all", [], {"anywhere.else": True, None: False}),
]


@pytest.mark.parametrize("scope, allow, hosts", SCOPES)
def test_scope(spark, scope, allow, hosts):
    df = spark.createDataFrame([(h, allow) for h in hosts], "h string, a array<string>")
    got = df.select("h", U.in_scope(F.col("h"), F.lit("lake.test"), F.lit(scope), F.col("a")).alias("x")).collect()
    assert {r.h: r.x for r in got} == hosts


def test_resolve(spark):
    cases = [
        ("https://e.com/a/b?q#f", "c", "https://e.com/a/c"),
        ("https://e.com/a/b", "../x", "https://e.com/x"),
        ("https://e.com/a/b", "//o.com/y", "https://o.com/y"),
        ("https://e.com/a/b", "?z=1", "https://e.com/a/b?z=1"),
        ("https://e.com/a/b", "/é?q=ü'#x", "https://e.com/%C3%A9?q=%C3%BC%27#x"),
        ("https://e.com", "p", "https://e.com/p"),
        ("https://e.com/a", "mailto:x@y", None),
        ("https://e.com/a", "HTTP://E.com:80/z", "http://e.com/z"),
    ]
    df = spark.createDataFrame([(i, b, h) for i, (b, h, _) in enumerate(cases)], "i int, b string, h string")
    got = [r.u for r in U.absolute_url(df, "b", "h", "u").orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_assets_and_labels(spark):
    df = spark.createDataFrame(
        [("https://x.com/a.PNG", True), ("https://x.com/a.png?v=1", True), ("https://x.com/a", False), ("nope", False)],
        "u string, e boolean",
    )
    assert all(r.got == r.e for r in df.withColumn("got", U.is_asset_url(F.col("u"))).collect())
    labels = spark.createDataFrame(
        [
            (" al ", "t", "https://x.com/a", "al"), ("", "t ", "https://x.com/a", "t"), (None, None, "https://x.com/a/b/", "b"),
            (None, None, "https://www.x.com/", "x.com"), (None, None, "https://x.com/%E4%B8%AD%E6%96%87", "中文"),
            (None, None, "ftp://x", "ftp://x"),
        ],
        "a string, t string, u string, e string",
    )
    out = U.normalize_url(labels, "u", "n").withColumn("l", U.display_label(F.col("a"), F.col("t"), F.col("n"), F.col("u")))
    assert all(r.l == r.e for r in out.collect())


def test_pagination(spark):
    cases = [
        ("https://e.com/a?page=3", 3, "https://e.com/a?|query:page"),
        ("https://e.com/list/page/12/", 12, "https://e.com/list|path"),
        ("https://e.com/l?offset=40&z=1", 40, "https://e.com/l?z=1|query:offset"),
        ("https://e.com/?q=abc", None, None),
        ("https://e.com/?page=all", None, None),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(cases)], "i int, u string")
    got = [(r.p.page_number, r.p.series_key) for r in U.pagination(df, "u", "p").orderBy("i").collect()]
    assert got == [(n, k) for _, n, k in cases]


def test_prefixes(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/",), ("/ab",)], "p string")
    got = [r.x for r in df.select(U.path_prefixes(F.col("p")).alias("x")).collect()]
    assert got == [["/a", "/a/b", "/a/b/c"], [], ["/ab"]]
