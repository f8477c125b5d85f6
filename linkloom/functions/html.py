"""Links, text and features of stored HTML, by regular expressions in the JVM.

Whole texts are processed.  Patterns use possessive quantifiers so that long
attributes neither backtrack nor recurse.  Comments and elements with raw text
go in one pass, whichever opens first; attributes are read one after another, so
a name inside another value is not found.  Known limits: same-named tags nested
inside nav/footer/aside, and entities written without their semicolon.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.pin import let, pinned
from .urls import absolute_url

# ---- fixed values -------------------------------------------------------
SKIPPED_SCHEMES = ("mailto:", "tel:", "javascript:", "data:", "blob:", "file:", "ftp:")
NON_CONTENT_TAGS = ("script", "style", "noscript", "template")
BOILERPLATE_TAGS = ("nav", "footer", "aside")
MOUNT_ROOTS = ("root", "app", "__next")
RAW_TEXT_TAGS = ("textarea", "title", "iframe", "xmp")
FINGERPRINT_MIN = 64
# -------------------------------------------------------------------------

# the standard's own names, of which those with a semicolon are decoded
_ENTITIES = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})
_WINDOWS = json.dumps({chr(i): c for i in range(128, 160) if (c := bytes([i]).decode("cp1252", "ignore"))})
_REFERENCE = "&(?:#[0-9]++|#[xX][0-9a-fA-F]++|[A-Za-z][A-Za-z0-9]*+);"
_ATTRS = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_SPACE = r"[\s\x{a0}\x{feff}]+"


def _drop_elements(html: Column, tags: tuple[str, ...]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*+>.*?(?:</{tag}\s*>|\z)", "")
    return html


def drop_raw(html: Column, tags: tuple[str, ...] = NON_CONTENT_TAGS) -> Column:
    """Without comments and the given elements; what opens first hides what it contains."""
    return F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(tags)})\b[^>]*+>.*?(?:</\1\s*>|\z)", "")


def _character(digits: Column, base: int) -> Column:
    """The character of a code in digits; NULL beyond the last code point."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    point = F.lpad(F.conv(short, base, 16), 8, "0")
    odd = (point == "00000000") | point.between("0000D800", "0000DFFF")
    char = let(F.decode(F.unhex(point), "UTF-32"), lambda c: F.coalesce(F.element_at(F.from_json(F.lit(_WINDOWS), "map<string,string>"), c), c))
    return F.when(F.length(short) <= 8, F.when(odd, "\ufffd").when(point <= "0010FFFF", char))


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references that end with a semicolon, each once.

    Codes 128 to 159 mean what they mean in Windows-1252, as the standard has it;
    0 and halves of pairs give U+FFFD, and codes beyond the last stay as they are.
    """

    def one(ref: Column) -> Column:
        table = F.from_json(F.lit(_ENTITIES), "map<string,string>")  # folded into a literal
        inner = F.substring(ref, F.lit(2), F.length(ref) - 2)
        found = (
            F.when(inner.startswith("#x") | inner.startswith("#X"), _character(F.substring(inner, F.lit(3), F.length(inner)), 16))
            .when(inner.startswith("#"), _character(F.substring(inner, F.lit(2), F.length(inner)), 10))
            .otherwise(F.element_at(table, inner))
        )
        return F.coalesce(found, ref)

    def decoded(t: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), one)
        between = F.split(t, _REFERENCE, -1)
        return F.array_join(F.zip_with(between, F.concat(refs, F.array(F.lit(""))), lambda x, y: F.concat(x, y)), "")

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")) & F.contains(t, F.lit(";")), decoded(t)).otherwise(t))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?s)</?[a-zA-Z!]{_ATTRS}>", "")


_TOKEN = r"""[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)?"""


def attribute(tag_text: Column, name: str) -> Column:
    """Value of an attribute inside the text of a start tag: of the first of that name, '' without a value; NULL when absent."""
    tokens = F.regexp_extract_all(tag_text, F.lit(_TOKEN), F.lit(0))
    own = F.get(F.filter(tokens, lambda x: x.rlike(rf"(?is)^{name}\s*(=|$)")), 0)
    pattern = r"""(?s)^[^=]*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'].*+))$"""
    return let(own, lambda x: decode_entities(F.concat(*[F.regexp_extract(x, pattern, i) for i in (1, 2, 3)])))


def page_anchors(pages: DataFrame, html: str = "html", page_url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus the anchors of each page as raw text, and what resolves them.

    Slim compared with the page, so it can be stored and read again instead of
    the page text.
    """
    body = drop_raw(F.col(html), NON_CONTENT_TAGS + RAW_TEXT_TAGS)
    anchor_re = rf"(?is)<a\s{_ATTRS}>.*?(?:</a\s*>|(?=<a[\s>])|\z)"
    base_tag = F.regexp_extract(F.col("_b"), rf"(?is)<base\s({_ATTRS})>", 1)
    df = pages.select(*keep, F.col(page_url).alias("_page"), body.alias("_b"))
    return df.select(
        *keep,
        "_page",
        attribute(F.nullif(base_tag, F.lit("")), "href").alias("_base_href"),
        F.regexp_extract_all(F.col("_b"), F.lit(anchor_re), F.lit(0)).alias("_anchors"),
    )


def extract_links(
    pages: DataFrame, html: str = "html", page_url: str = "url", keep: tuple[str, ...] = (), text_max: int | None = None
) -> DataFrame:
    """One row per kept ``<a href>`` (see ``links_of``)."""
    return links_of(page_anchors(pages, html, page_url, keep), keep, text_max)


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def links_of(anchors: DataFrame, keep: tuple[str, ...] = (), text_max: int | None = None) -> DataFrame:
    """Links of ``page_anchors`` rows: one row per kept anchor.

    Output: ``keep`` columns plus href, url, anchor_text, rel, target,
    is_nofollow, fragment, anchor_pos (document order; see ``number_links``).
    """
    skipped = r"(?i)^(#|" + "|".join(SKIPPED_SCHEMES) + ")"

    def anchor_parts(anchor: Column, pos: Column) -> Column:
        tag = F.regexp_extract(anchor, rf"(?is)^<a\s({_ATTRS})>", 1)
        return let(
            tag,
            lambda t: F.struct(
                F.trim(attribute(t, "href")).alias("href"), t.alias("tag"), anchor.alias("anchor"), pos.alias("pos")
            ),
        )

    df = anchors.select(*keep, "_page", "_base_href", "_anchors")
    df = absolute_url(df, "_page", "_base_href", "_based")
    kept = F.filter(
        F.transform("_anchors", anchor_parts),
        lambda a: a["href"].isNotNull() & (a["href"] != "") & ~a["href"].rlike(skipped),
    )
    df = df.select(*keep, F.coalesce("_based", "_page").alias("_base"), F.explode(kept).alias("_a"))
    df = df.select(*keep, "_base", F.col("_a.href").alias("href"), F.col("_a").alias("_a"))
    df = absolute_url(df, "_base", "href", "url").filter(F.col("url").isNotNull())
    tag = F.col("_a.tag")
    inner = F.regexp_replace(F.col("_a.anchor"), rf"(?is)^<a\s{_ATTRS}>|</a\s*>\z", "")
    rel = attribute(tag, "rel")
    return df.select(
        *keep,
        "href",
        "url",
        _cut(collapse(decode_entities(strip_tags(inner))), text_max).alias("anchor_text"),
        rel.alias("rel"),
        attribute(tag, "target").alias("target"),
        F.coalesce(F.lower(rel).rlike(r"(^|\s)nofollow(\s|$)"), F.lit(False)).alias("is_nofollow"),
        F.nullif(F.regexp_extract("url", "#(.+)$", 1), F.lit("")).alias("fragment"),
        F.col("_a.pos").alias("anchor_pos"),
    )


def number_links(links: DataFrame, *page_key: str) -> DataFrame:
    """Replace ``anchor_pos`` by ``order_in_page`` (0, 1, … over kept links).

    One window per page; a page's links are bounded by its text.
    """
    w = Window.partitionBy(*page_key).orderBy("anchor_pos")
    return links.withColumn("order_in_page", F.row_number().over(w) - 1).drop("anchor_pos")


def body_html(html: Column) -> Column:
    """Inside of ``<body>``; text without head when there is no body tag; end may be missing."""
    inside = F.regexp_extract(html, rf"(?is)<body\b{_ATTRS}>(.*?)(?:</body\s*>|\z)", 1)
    rest = F.regexp_replace(html, r"(?is)<head\b[^>]*+>.*?(?:</head\s*>|\z)|<title\b[^>]*+>.*?</title\s*>", "")
    return F.when(html.rlike(r"(?i)<body\b"), inside).otherwise(rest)


def page_text(html: Column, drop: tuple[str, ...]) -> Column:
    cleaned = _drop_elements(drop_raw(html), tuple(t for t in drop if t not in NON_CONTENT_TAGS))
    return collapse(decode_entities(strip_tags(let(cleaned, body_html))))


def extract_content(pages: DataFrame, html: str = "html", title_max: int | None = None, description_max: int | None = None) -> DataFrame:
    """Add title, description, text, text_length; lengths are cut only where a maximum is given."""
    h = F.col(html)
    clean = drop_raw(h)
    title = F.trim(decode_entities(F.regexp_extract(clean, r"(?is)<title\b[^>]*+>(.*?)(?:</title\s*>|\z)", 1)))
    meta = F.regexp_extract(clean, r"""(?is)<meta\s([^>]*?\bname\s*+=\s*+["']?description\b[^>]*+)>""", 1)
    description = F.trim(attribute(F.nullif(meta, F.lit("")), "content"))
    df = pinned(pages.withColumn("text", page_text(h, NON_CONTENT_TAGS + BOILERPLATE_TAGS)), "text")
    return df.select(
        *[c for c in df.columns if c not in ("title", "description", "text_length")],
        F.nullif(_cut(title, title_max), F.lit("")).alias("title"),
        F.nullif(_cut(description, description_max), F.lit("")).alias("description"),
        F.length("text").alias("text_length"),
    )


def content_fingerprint(text: Column, chars: int | None = None, least: int = FINGERPRINT_MIN) -> Column:
    """SHA-256 of all letters and digits; NULL for texts of fewer than ``least``.

    ``chars`` hashes only so many of them, for comparison with fingerprints made
    that way.
    """
    letters = _cut(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", ""), chars)
    return let(letters, lambda x: F.when(F.length(x) >= least, F.sha2(x, 256)))


def content_class(content_type: Column) -> Column:
    """html / asset / other.  Asset wins, as it is tested first when a page is handled."""
    ct = F.lower(content_type)
    asset = ct.rlike("image/|video/|audio/|application/pdf|application/zip|application/octet-stream|font/")
    html = ct.isNull() | ct.rlike("text/html|application/xhtml[+]xml|^text/plain")
    return F.when(F.coalesce(asset, F.lit(False)), "asset").when(html, "html").otherwise("other")


def render_features(pages: DataFrame, html: str = "html", page_url: str = "url") -> DataFrame:
    """Script count, mount root, text length and link count of each page."""
    opened = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*+>.*?(?:</script\s*>|\z)"), F.lit(0))
    kept = drop_raw(F.col(html))
    mount = kept.rlike(
        rf"""(?is)<[a-z][^>]*\sid\s*=\s*["']?({"|".join(MOUNT_ROOTS)})["'\s>]|<[a-z][^>]*\sdata-reactroot[\s=>]"""
    )
    scripts = F.size(F.filter(opened, lambda x: ~F.startswith(x, F.lit("<!--"))))
    hrefs = F.regexp_extract_all(kept, F.lit(r"""(?is)<a\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""), F.lit(1))
    skip = r"(?i)^(#|" + "|".join(SKIPPED_SCHEMES) + ")"
    return pages.select(
        *pages.columns,
        scripts.alias("script_count"),
        mount.alias("has_mount_root"),
        F.length(page_text(F.col(html), NON_CONTENT_TAGS)).alias("text_length"),
        F.size(F.filter(hrefs, lambda x: ~x.rlike(skip))).alias("link_count"),
    )


def render_decision(features: DataFrame, mode: str = "auto", static_ok: str = "static_ok") -> DataFrame:
    """Add ``render_decision``: which pages need a capture with scripts run."""
    ok = F.col(static_ok)
    spa = (F.col("script_count") >= 3) & F.col("has_mount_root")
    if mode == "browser":
        verdict = F.lit("forced-browser")
    elif mode == "http":
        verdict = F.when(ok, "static-enough").otherwise("static-error")
    else:
        verdict = (
            F.when(~ok, "static-error")
            .when(F.col("link_count") == 0, "no-links-fallback")
            .when(spa & (F.col("text_length") < 200), "spa-fallback")
            .otherwise("static-enough")
        )
    return features.withColumn("render_decision", verdict)
