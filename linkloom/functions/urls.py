"""URL identity, scope and pattern helpers as native Spark expressions.

URLs are split once into their parts with a single regular expression pass
(``split_url``); everything after that is plain string work inside the JVM.
Parsing follows the rules browsers use for http(s) URLs.  Known limits: hosts
with non-ASCII letters are lower-cased but not converted to punycode, and
numeric IPv4 shorthand is not expanded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.pin import let, pinned

# ---- fixed values -------------------------------------------------------
TRACKING_PREFIXES = ("utm_",)
TRACKING_NAMES = ("sessionid", "_ga")
PAGE_KEYS = ("page", "p", "pn", "pg", "paged", "offset", "start")
ASSET_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "bmp", "avif", "pdf", "zip", "gz", "tgz", "bz2", "7z", "rar",
    "mp3", "wav", "ogg", "m4a", "mp4", "m4v", "mov", "avi", "webm", "woff", "woff2", "ttf", "eot", "otf", "doc",
    "docx", "xls", "xlsx", "ppt", "pptx", "epub", "csv", "json", "xml", "rss", "atom",
)
# -------------------------------------------------------------------------

_SEP = "\u0001"
_BLANK = r"[\s\x00-\x1f\x{a0}\x{feff}]"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
# scheme, userinfo, host, port, path, query, fragment
_PARTS = (
    r"^([hH][tT][tT][pP][sS]?):[/\\]*(?:([^/\\?#]*)@)?(\[[0-9a-fA-F:.]+\]|[^/\\?#:@\[\]]+)"
    r"(?::([0-9]*))?((?:[/\\][^?#]*)?)((?:\?[^#]*)?)((?:#.*)?)$"
)
_BAD_HOST = r"[\x00-\x20<>^|%\x7f]"
_DOT_SEGMENT = r"(?i)/(\.|%2e){1,2}(/|$)"

# characters that stay as they are, per URL part (letters, digits, - . _ * always do)
_PATH_KEEP = "/:@!$&'()+,;=~[]|"
_QUERY_KEEP = "/:@!$&()+,;=~[]|?`{}^\\"
_FRAGMENT_KEEP = "/:@!$&'()+,;=~[]|?{}^\\#"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _percent_encode(name: str, keep: str) -> Column:
    """Percent-encode all of column ``name`` but ``keep``; existing ``%XX`` escapes are left alone.

    One SQL text instead of a call per character keeps plan building quick.
    """
    encoded = f"replace(url_encode(`{name}`), '+', '%20')"
    for ch in keep:
        encoded = f"replace({encoded}, '%{ord(ch):02X}', {_literal(ch)})"
    return F.when(F.col(name).rlike(r"[^\x21-\x7e]|[\"<>`{}^']"), F.expr(f"replace({encoded}, '%25', '%')")).otherwise(
        F.col(name)
    )


def _form_decode(c: Column) -> Column:
    """Form decoding that keeps stray percent signs."""
    return F.when(
        c.rlike("[%+]"), F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))
    ).otherwise(c)


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""

    def step(acc: Column, seg: Column) -> Column:
        plain = F.replace(F.lower(seg), F.lit("%2e"), F.lit("."))
        shorter = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)
        return F.when(plain == "..", shorter).when(plain == ".", acc).otherwise(F.array_append(acc, seg))

    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_open = F.element_at(segments, -1).rlike(r"(?i)^(\.|%2e){1,2}$")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    resolved = F.when(ends_open & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(_DOT_SEGMENT), resolved).otherwise(path)


_NUMBER_HOST = r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"


def _ipv4(host: Column) -> Column:
    """A host that ends in a number as four decimal bytes: hexadecimal and octal parts, and a last part that stands for several bytes; NULL if it is none."""

    def number(x: Column) -> Column:
        digits = (
            F.when(x.rlike("^0x[0-9a-f]{0,12}$"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 12)), 16, 10))
            .when(x.rlike("^0[0-7]{1,16}$"), F.conv(x, 8, 10))
            .when(x.rlike("^(0|[1-9][0-9]{0,12})$"), x)
        )
        return digits.cast("bigint")

    def joined(n: Column) -> Column:
        heads, last = F.slice(n, 1, F.size(n) - 1), F.element_at(n, -1)
        value = F.aggregate(F.transform(heads, lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("bigint")), last, lambda a, x: a + x)
        fits = (F.size(n) <= 4) & F.forall(heads, lambda x: F.coalesce(x <= 255, F.lit(False))) & (last < F.pow(F.lit(256), 5 - F.size(n)))
        return F.when(fits, F.concat_ws(".", *[F.shiftright(value, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)]))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), joined)


def _host(raw: Column) -> Column:
    """Host in lower case, percent-decoded, in ASCII; NULL where it can't be."""
    plain = F.lower(F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))).otherwise(raw))
    ascii_ = F.when(plain.rlike(r"[^\x00-\x7f]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain))).otherwise(plain)
    return let(ascii_, lambda h: F.when(h.rlike(_NUMBER_HOST), _ipv4(h)).otherwise(h))


def split_url(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add ``{prefix}proto, auth, host, port, path, query, frag`` (all NULL if invalid).

    A missing scheme is read as https; any scheme but http(s) is invalid.
    """
    p = prefix
    raw = F.regexp_replace(F.col(url), rf"^{_BLANK}+|{_BLANK}+$|[\t\r\n]", "")
    df = df.withColumn(f"{p}raw", raw)
    r = F.col(f"{p}raw")
    candidate = (
        F.when(r.rlike("^(?i)https?:"), r)
        .when((r == "") | r.rlike(_SCHEME), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://"), r))
    )
    marked = F.regexp_replace(candidate, _PARTS, _SEP.join(f"${i}" for i in range(1, 8)))
    df = df.withColumn(f"{p}parts", F.split(marked, _SEP, -1))
    parts = F.col(f"{p}parts")
    port = F.regexp_replace(F.get(parts, 3), "^0+(?=[0-9])", "")
    df = df.withColumn(f"{p}hostname", _host(F.get(parts, 2)))
    host = F.col(f"{p}hostname")
    valid = (F.size(parts) == 7) & ~host.rlike(_BAD_HOST) & ((F.length(port) < 5) | (port <= "65535") & (F.length(port) == 5))
    df = df.withColumn(f"{p}ok", F.coalesce(valid, F.lit(False)))
    ok = F.col(f"{p}ok")
    slashed = F.replace(F.get(parts, 4), F.lit("\\"), F.lit("/"))
    df = df.withColumn(f"{p}rooted", F.when(F.get(parts, 4) == "", F.lit("/")).otherwise(slashed))
    df = df.select("*", _resolve_dots(F.col(f"{p}rooted")).alias(f"{p}dotless"), F.get(parts, 6).alias(f"{p}rawfrag"))
    proto = F.lower(F.get(parts, 0))
    default = F.when(proto == "http", F.lit("80")).otherwise(F.lit("443"))
    auth = F.get(parts, 1)
    return df.select(
        *[c for c in df.columns if not c.startswith(p)],
        F.when(ok, proto).alias(f"{p}proto"),
        F.when(ok, F.when(auth.startswith(":"), "").otherwise(F.regexp_replace(auth, ":$", ""))).alias(f"{p}auth"),
        F.when(ok, host).alias(f"{p}host"),
        F.when(ok, F.when(port == default, "").otherwise(port)).alias(f"{p}port"),
        F.when(ok, _percent_encode(f"{p}dotless", _PATH_KEEP)).alias(f"{p}path"),
        F.when(ok, F.get(parts, 5)).alias(f"{p}query"),
        F.when(ok, _percent_encode(f"{p}rawfrag", _FRAGMENT_KEEP)).alias(f"{p}frag"),
    )


_SPLIT_NAMES = ("proto", "auth", "host", "port", "path", "query", "frag")


def _query_pairs(query: Column) -> Column:
    """``?a=1&b=2`` → array of (k, v), decoded, in order."""
    items = F.filter(F.split(F.substring(query, 2, 1 << 30), "&", -1), lambda s: s != "")
    return F.transform(
        items,
        lambda s: F.struct(
            _form_decode(F.substring_index(s, "=", 1)).alias("k"),
            F.when(F.locate("=", s) > 0, _form_decode(F.regexp_replace(s, "^[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("v"),
        ),
    )


def normalize_url(
    df: DataFrame,
    url: str,
    out: str = "norm",
    *,
    drop_www: bool = True,
    force_https: bool = False,
    blacklist: Sequence[str] = (),
) -> DataFrame:
    """Add the struct ``out`` with the canonical form of ``url``; NULL if invalid."""
    p = f"__{out}_"
    df = split_url(df, url, p)
    proto, auth, host0, port, path, query, frag = (F.col(f"{p}{n}") for n in _SPLIT_NAMES)

    host = F.regexp_replace(host0, r"^www\.", "") if drop_www else host0
    if force_https:
        upgraded = (proto == "http") & (port == "")
        scheme = F.when(upgraded, F.lit("https")).otherwise(proto)
    else:
        scheme = proto
    stripped = F.regexp_replace(path, "/+$", "")
    pathname = F.when(stripped == "", F.lit("/")).otherwise(stripped)

    dropped = [*TRACKING_NAMES, *[b.lower() for b in blacklist]]

    def keep(pair: Column) -> Column:
        name = F.lower(pair["k"])
        tracked = reduce(lambda a, b: a | b, [name.startswith(t) for t in TRACKING_PREFIXES])
        return ~(tracked | name.isin(dropped))

    pairs = F.array_sort(F.filter(_query_pairs(query), keep))
    serial = F.array_join(
        F.transform(pairs, lambda q: F.concat(F.url_encode(q["k"]), F.lit("="), F.url_encode(q["v"]))), "&"
    )
    search = F.when(F.length(query) > 1, serial).when(query.isNotNull(), F.lit(""))
    # the pieces are materialised as columns first so that no expression is repeated
    df = df.select(
        *[c for c in df.columns if not c.startswith(p)],
        host0.alias(f"{p}host0"),
        host.alias(f"{p}host"),
        scheme.alias(f"{p}scheme"),
        F.when(port != "", port).alias(f"{p}port"),
        pathname.alias(f"{p}pathname"),
        search.alias(f"{p}search"),
        F.when(F.length(frag) > 1, F.substring(frag, 2, 1 << 30)).alias(f"{p}fragment"),
        auth.alias(f"{p}auth"),
    )
    c = lambda n: F.col(f"{p}{n}")
    authority = F.concat(c("host"), F.when(c("port").isNotNull(), F.concat(F.lit(":"), c("port"))).otherwise(""))
    identity = F.concat(
        c("scheme"),
        F.lit("://"),
        F.when(c("auth") != "", F.concat(c("auth"), F.lit("@"))).otherwise(""),
        authority,
        c("pathname"),
        F.when(c("search") != "", F.concat(F.lit("?"), c("search"))).otherwise(""),
    )
    df = df.withColumn(f"{p}identity", identity)
    full = F.concat(c("identity"), F.when(c("fragment").isNotNull(), F.concat(F.lit("#"), c("fragment"))).otherwise(""))
    struct = F.struct(
        full.alias("url"),
        c("identity").alias("identity_key"),
        F.concat(c("scheme"), F.lit("://"), authority).alias("origin"),
        c("host0").alias("host"),
        c("host").alias("normalized_host"),
        F.concat(c("scheme"), F.lit(":")).alias("protocol"),
        c("port").alias("port"),
        c("pathname").alias("pathname"),
        c("search").alias("search"),
        c("fragment").alias("fragment"),
        c("scheme").alias("scope"),
    )
    df = df.select(
        *[n for n in df.columns if not n.startswith(p) and n != out],
        F.when(c("identity").isNotNull(), struct).alias(out),
    )
    return pinned(df, out)


def same_identity(a: Column, b: Column) -> Column:
    """Equality of two identity keys; an invalid URL equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def absolute_url(df: DataFrame, base: str, href: str, out: str = "url") -> DataFrame:
    """Resolve ``href`` against ``base``; NULL when the result is not http(s)."""
    p = f"__{out}_"
    h = F.regexp_replace(F.trim(F.col(href)), r"^\s+|\s+$|[\t\r\n]", "")
    df = df.withColumn(f"{p}h", h)
    h = F.col(f"{p}h")
    b = F.regexp_replace(F.col(base), "#.*$", "")
    origin = F.regexp_extract(b, r"^((?i:https?)://[^/?#]*)", 1)
    bpath = F.regexp_extract(b, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    folder = F.when(bpath == "", F.lit("/")).otherwise(F.regexp_replace(bpath, "[^/]*$", ""))
    slashed = F.when(h.rlike(r"^[/\\]{2}"), F.regexp_replace(h, r"^[/\\]{2}", "//")).otherwise(
        F.regexp_replace(h, r"^\\", "/")
    )
    joined = (
        F.when(h.rlike("^(?i)https?:"), h)
        .when(h.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(slashed.startswith("//"), F.concat(F.regexp_extract(b, "^([^:]+:)", 1), slashed))
        .when(slashed.startswith("/"), F.concat(origin, slashed))
        .when(h.startswith("?"), F.concat(origin, bpath, h))
        .when(h.startswith("#"), F.concat(b, h))
        .when(h == "", b)
        .otherwise(F.concat(origin, folder, h))
    )
    df = split_url(df.withColumn(f"{p}joined", joined), f"{p}joined", p)
    c = lambda n: F.col(f"{p}{n}")
    url = F.concat(
        c("proto"),
        F.lit("://"),
        F.when(c("auth") != "", F.concat(c("auth"), F.lit("@"))).otherwise(""),
        c("host"),
        F.when(c("port") != "", F.concat(F.lit(":"), c("port"))).otherwise(""),
        c("path"),
        _percent_encode(f"{p}query", _QUERY_KEEP),
        c("frag"),
    )
    df = df.select(*[n for n in df.columns if not n.startswith(p) and n != out], url.alias(out))
    return pinned(df, out)


def in_scope(host: Column, root_host: Column, scope: Column, allowlist: Column) -> Column:
    """Scope rule of a site over normalised hosts; an invalid (NULL) host is out."""
    same_site = (host == root_host) | host.endswith(F.concat(F.lit("."), root_host))

    def listed(raw: Column) -> Column:
        pattern = F.regexp_replace(F.lower(F.trim(raw)), r"^\.", "")
        base = F.substring(pattern, 3, 1 << 30)
        wild = (host != base) & host.endswith(F.concat(F.lit("."), base))
        return (pattern != "") & F.when(pattern.startswith("*."), wild).otherwise(host == pattern)

    allowed = F.coalesce(F.exists(allowlist, listed), F.lit(False))
    verdict = (
        F.when(scope == "all", host.isNotNull())
        .when(scope == "same_domain", host == root_host)
        .when(scope == "same_site", same_site)
        .when(scope == "allowlist", same_site | allowed)
        .otherwise(False)
    )
    return F.coalesce(verdict & host.isNotNull() & root_host.isNotNull(), F.lit(False))


def url_path(url: Column) -> Column:
    """Path of an absolute URL (not validated); empty path reads as ``/``."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def is_asset_url(url: Column) -> Column:
    """The path ends with a known non-HTML extension."""
    pattern = r"(?i)\.(" + "|".join(ASSET_EXTENSIONS) + ")$"
    valid = url.rlike("^(?i)https?://[^/?#]")
    return F.coalesce(valid & url_path(url).rlike(pattern), F.lit(False))


def pagination(df: DataFrame, url: str, out: str = "pagination") -> DataFrame:
    """Add struct ``out`` (is_paged, page_number, series_key) for an absolute URL."""
    p = f"__{out}_"
    df = split_url(df, url, p)
    c = lambda n: F.col(f"{p}{n}")
    origin = F.concat(
        c("proto"), F.lit("://"), c("host"), F.when(c("port") != "", F.concat(F.lit(":"), c("port"))).otherwise("")
    )
    path_re = r"(?i)/page/([0-9]+)/?$"
    df = df.select(
        *[n for n in df.columns if not n.startswith(p)],
        origin.alias(f"{p}origin"),
        c("path").alias(f"{p}path"),
        F.nullif(F.regexp_extract(c("path"), path_re, 1), F.lit("")).alias(f"{p}num"),
        F.when(F.length(c("query")) > 1, _query_pairs(c("query"))).alias(f"{p}pairs"),
    )
    pairs = c("pairs")

    def first_value(key: str) -> Column:
        return F.get(F.filter(pairs, lambda q: q["k"] == key), 0)["v"]

    hit = F.coalesce(
        *[
            F.when(
                F.trim(first_value(k)).rlike("^[0-9]+$"),
                F.struct(F.lit(k).alias("k"), F.trim(first_value(k)).alias("v")),
            )
            for k in PAGE_KEYS
        ]
    )
    df = df.withColumn(f"{p}hit", F.when(pairs.isNotNull(), hit))
    placed = F.transform(pairs, lambda q, i: F.struct(q["k"].alias("k"), i.alias("i"), q["v"].alias("v")))
    others = F.array_join(
        F.transform(
            F.array_sort(F.filter(placed, lambda q: q["k"] != c("hit")["k"])),
            lambda q: F.concat(q["k"], F.lit("="), q["v"]),
        ),
        "&",
    )
    by_path = F.concat(c("origin"), F.regexp_replace(c("path"), path_re, ""), F.lit("|path"))
    by_query = F.concat(c("origin"), c("path"), F.lit("?"), others, F.lit("|query:"), c("hit")["k"])
    series = F.when(c("num").isNotNull(), by_path).when(c("hit").isNotNull(), by_query)
    number = F.when(c("num").isNotNull(), c("num")).otherwise(c("hit")["v"]).try_cast("bigint")
    df = df.select(
        *[n for n in df.columns if not n.startswith(p)],
        F.struct(
            (c("num").isNotNull() | c("hit").isNotNull()).alias("is_paged"),
            number.alias("page_number"),
            series.alias("series_key"),
        ).alias(out),
    )
    return pinned(df, out)


def path_prefixes(path: Column) -> Column:
    """``/a/b`` → ``['/a', '/a/b']`` by whole segments."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    n = F.size(segments)
    prefix = lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), prefix)).otherwise(F.array().cast("array<string>"))


def first_segment(path: Column) -> Column:
    """Shallowest prefix of a path, NULL for the root."""
    return F.nullif(F.regexp_extract(path, "^/*(/[^/]+)", 1), F.lit(""))


def path_tail(norm: Column, raw: Column) -> Column:
    """Last decoded path segment; host for the root; the input when invalid."""
    last = F.regexp_extract(norm["pathname"], "([^/]*)$", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    return F.when(norm.isNull(), raw).when(norm["pathname"] == "/", norm["normalized_host"]).otherwise(decoded)


def display_label(alias: Column, title: Column, norm: Column, raw: Column) -> Column:
    """First non-blank of alias, title, path tail."""
    named = [F.nullif(F.trim(c), F.lit("")) for c in (alias, title)]
    return F.coalesce(*named, path_tail(norm, raw))


def node_id(site_id: Column, identity_key: Column) -> Column:
    """Deterministic node id, stable across reruns."""
    return F.sha2(F.concat_ws("\u0000", site_id, identity_key), 256)
