"""Links, texts and features of pages made up here, and robots files of our own."""

import pytest
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.sources import robots as R

HOME = "https://harbour.test/tides/today"


def frame(spark, html, url=HOME):
    return spark.createDataFrame([(1, url, html)], "pid int, url string, html string")


def links(spark, html, **kw):
    rows = H.number_links(H.extract_links(frame(spark, html), keep=("pid",), **kw), "pid").orderBy("order_in_page").collect()
    assert [r.order_in_page for r in rows] == list(range(len(rows)))
    return rows


def urls(spark, html):
    return [r.url.removeprefix("https://harbour.test") for r in links(spark, html)]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p><a href=now>n</a><a href='?h=3'>q</a><a href=\"../moon\">m</a>", ["/tides/now", "/tides/today?h=3", "/moon"]),
        ("<base href=/charts/><a href=north>n</a>", ["/charts/north"]),
        # a script that mentions a comment hides nothing behind it, nor a comment that mentions a script
        ("<script>var a='<!-- x';</script><a href=/after>a</a>", ["/after"]),
        ("<!-- <script> --><a href=/b>b</a><!-- </script> -->", ["/b"]),
        ("<style>a{content:'<!--'}</style><a href=/c>c</a>", ["/c"]),
        ("<!-- never closed <a href=/d>d</a>", []),
        # an attribute's name inside another one's value
        ("<a title=\"set href=/wrong here\" href=/right>r</a>", ["/right"]),
        ("<a data-href=/wrong href = '/right'>r</a>", ["/right"]),
        ("<a href=/first href=/second>twice</a>", ["/first"]),
        # elements whose content is text
        ("<textarea><a href=/t>t</a></textarea><xmp><a href=/x>x</a></xmp><iframe><a href=/i>i</a></iframe><a href=/k>k</a>", ["/k"]),
        ("<title><a href=/t></title><noscript><a href=/n></noscript><template><a href=/p></template>", []),
        # schemes and anchors that lead nowhere
        ("<a href='tel:123'>t</a><a href=' JavaScript:go()'>j</a><a href='#low'>h</a><a href=''>e</a><a>none</a>", []),
        ("<a\n\thref='/wide'\n>w</a ><A HREF=/upper>U</A>", ["/wide", "/upper"]),
        ("<a href='/x?a=1&AMP;b=2&amp;c=&#x33;&#X34;'>e</a>", ["/x?a=1&b=2&c=34"]),
    ],
)
def test_targets(spark, html, expected):
    assert urls(spark, html) == expected


def test_link_details(spark):
    one, two = links(spark, "<a rel='Friend NoFollow' target=map href=/isle#cove>to <i>the</i>\n isle &eacute;&nbsp;&Uuml;</a><a href=/plain>" + "long " * 200 + "</a>")
    assert (one.anchor_text, one.rel, one.target, one.is_nofollow, one.fragment) == ("to the isle é Ü", "Friend NoFollow", "map", True, "cove")
    assert (two.rel, two.target, two.is_nofollow, two.fragment) == (None, None, False, None)
    assert len(two.anchor_text) == 999 and len(links(spark, "<a href=/p>abcdef</a>", text_max=4)[0].anchor_text) == 4


def content(spark, html, **kw):
    return H.extract_content(frame(spark, html), **kw).first()


def test_content(spark):
    row = content(spark, "<html><head><title>Ebb &amp; flow &rarr; &#9875;</title><meta content='when \"it\" turns' name=\"description\"></head>"
                  "<body><aside>ads</aside><p>High <b>water</b> at 3</p><footer>imprint</footer><script>'</body>'</script> &frac12; &notareal; end</body></html>")
    assert (row.title, row.description) == ("Ebb & flow → ⚓", 'when "it" turns')
    assert row.text == "High water at 3 ½ &notareal; end" and row.text_length == len(row.text)
    assert content(spark, "<p>no body <br>tag").text == "no body tag"
    assert content(spark, "<body>open <i>end").text == "open end"
    long = content(spark, f"<title>{'t' * 700}</title>")
    assert len(long.title) == 700 and len(content(spark, f"<title>{'t' * 700}</title>", title_max=9).title) == 9


def test_entities_are_decoded_once(spark):
    cases = {"&amp;lt;": "&lt;", "&AMP;": "&", "&lt;&gt;": "<>", "&#233;&#xe9;&#XE9;": "ééé", "&CounterClockwiseContourIntegral;": "∳", "&amp;amp;": "&amp;", "a & b": "a & b", "&#9999999;": "&#9999999;", "&#38;amp;": "&amp;", "&#38;#x3c;": "&#x3c;", "&#150;&#x80;": "–€", "&#x10FFFF;&#1048576;": "\U0010ffff\U00100000", "&#0;&#xD800;": "\ufffd\ufffd", "&#00000000000065;": "A", "&#99999999999999999999999;": "&#99999999999999999999999;", "&nosuch;&amp": "&nosuch;&amp", "&;": "&;"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.withColumn("got", H.decode_entities(F.col("raw"))).collect():
        assert r.got == r.want, r.raw


def test_long_attributes_do_not_overflow(spark):
    assert urls(spark, "<body><a data-z='" + "y" * 200_000 + "' href=/far>f</a>" + "z" * 400_000) == ["/far"]


def test_fingerprints_cover_whole_texts(spark):
    base = "The lamp of the lighthouse turns " * 400
    texts = [base + "left", base + "right", (base + "LEFT").upper() + "!", "too short", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.f for r in df.select("i", H.content_fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]
    assert got[0] == got[2] != got[1] and got[3] is None and got[4] is None
    cut = [r.f for r in df.select("i", H.content_fingerprint(F.col("t"), chars=4096).alias("f")).orderBy("i").collect()]
    assert cut[0] == cut[1]
    assert df.select(H.content_fingerprint(F.lit("short"), least=3).alias("f")).first().f


def test_render_decision(spark):
    columns = "static_ok boolean, link_count int, script_count int, has_mount_root boolean, text_length int"
    cases = [
        ((False, 9, 0, False, 900), "static-error"), ((True, 0, 0, False, 900), "no-links-fallback"), ((True, 2, 4, True, 150), "spa-fallback"),
        ((True, 2, 4, True, 250), "static-enough"), ((True, 2, 2, True, 150), "static-enough"), ((True, 2, 4, False, 150), "static-enough"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], columns)
    assert [r.render_decision for r in H.render_decision(df).collect()] == [v for _, v in cases]
    assert {r.render_decision for r in H.render_decision(df, "browser").collect()} == {"forced-browser"}
    assert [r.render_decision for r in H.render_decision(df, "http").collect()] == ["static-error"] + ["static-enough"] * 5
    app = "<script>1</script><!-- <script> --><script src=x></script><section><main id=app></main></section><a href=/one>1</a><a href='#no'>2</a>"
    row = H.render_features(frame(spark, app)).first()
    assert (row.script_count, row.has_mount_root, row.link_count) == (2, True, 1)


BUOY = """# lanes
user-agent: dredger
Disallow: /
Crawl-delay: 7

User-Agent: *
Disallow: /locks      # closed at night
Allow: /locks/visitor
Disallow: /*.tiff$
Disallow: /quay$
Sitemap: https://harbour.test/map.xml

User-agent: Pilot
Allow: /
"""


def allowed(spark, text, agent, paths):
    rules = R.robots_rules(spark.createDataFrame([("https://harbour.test", text)], "origin string, text string"), agent)
    pages = spark.createDataFrame([(i, "https://harbour.test" + p) for i, p in enumerate(paths)], "i int, url string")
    return [r.robots_allowed for r in R.robots_allowed(pages, rules).orderBy("i").collect()]


def test_robots(spark):
    paths = ["/locks/2", "/locks/visitor/9", "/scan.tiff", "/scan.tiff?big", "/quay", "/quays", "/"]
    assert allowed(spark, BUOY, "ferry", paths) == [False, True, False, True, False, True, True]
    assert allowed(spark, BUOY, "pilot/2.1", paths) == [True] * 7
    assert allowed(spark, BUOY, "Dredger", paths) == [False] * 7
    assert allowed(spark, "User-agent: dredger\nDisallow: /\n", "ferry", ["/a"]) == [True]
    text = spark.createDataFrame([("o", BUOY.replace("\n", "\r\n"))], "origin string, text string")
    assert {r.crawl_delay_ms for r in R.robots_rules(text, "dredger").collect()} == {7000}
    assert [r.sitemap for r in R.sitemaps(text).collect()] == ["https://harbour.test/map.xml"]
