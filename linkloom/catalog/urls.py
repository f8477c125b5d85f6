"""URL, HTML, robots and text queries over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from ..operators import export as X
from ..operators import guards as G
from ..operators import stats as S
from ..sources import robots as R
from ..sources.tables import append_fetch_logs, fetch_log_rows, scan_pages
from ..plans.stage import new_path
from .base import query

# ---- SQL building blocks for the comparison statements -------------------


def duck_encode(expr: str, keep: str) -> str:
    """Percent-encode non-ASCII and unsafe characters of a URL part."""
    out = f"url_encode({expr})"
    for ch in keep:
        quoted = "''" if ch == "'" else ch
        out = f"replace({out}, '%{ord(ch):02X}', '{quoted}')"
    return f"replace({out}, '%25', '%')"


PATH_KEEP = "/:@!$&'()+,;=[]|*"


def duck_norm(name: str, source: str, url: str) -> str:
    """CTEs that add ident, full_url, nhost, host0, path, search, frag, scheme to ``source``."""
    form = "replace(replace(replace(url_encode({0}), '%20', '+'), '%2A', '*'), '~', '%7E')"
    dec = "url_decode(replace({0}, '+', ' '))"
    key, val = dec.format("split_part(x, '=', 1)"), dec.format("regexp_replace(x, '^[^=]*=?', '')")
    return f"""{name}_a as (select *, lower(regexp_extract({url}, '(?i)^(https?)://', 1)) as scheme,
     lower(regexp_extract({url}, '(?i)^https?://([^/?#]*)', 1)) as host0,
     regexp_extract({url}, '(?i)^https?://[^/?#]*([^?#]*)', 1) as path0,
     regexp_extract({url}, '[?]([^#]*)', 1) as query0, nullif(regexp_extract({url}, '#(.*)$', 1), '') as frag
   from {source}),
 {name}_b as (select *, regexp_replace(host0, '^www[.]', '') as nhost,
     case when regexp_replace({duck_encode('path0', PATH_KEEP)}, '/+$', '') = '' then '/'
          else regexp_replace({duck_encode('path0', PATH_KEEP)}, '/+$', '') end as path,
     array_to_string(list_sort(list_transform(list_filter(string_split(query0, '&'),
       lambda x: x <> '' and not (starts_with(lower({key}), 'utm_') or lower({key}) in ('sessionid', '_ga'))),
       lambda x: {form.format(key)} || '=' || {form.format(val)})), '&') as search from {name}_a),
 {name} as (select *, scheme || '://' || nhost || path || case when search <> '' then '?' || search else '' end as ident,
     scheme || '://' || nhost || path || case when search <> '' then '?' || search else '' end
       || case when frag is null then '' else '#' || frag end as full_url from {name}_b)"""


STRIP = "html"
for _tag in ("script", "style", "noscript", "template"):
    STRIP = f"regexp_replace({STRIP}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gis')"
STRIP = f"regexp_replace({STRIP}, '<!--.*?-->', '', 'gs')"
CONTENT = STRIP
for _tag in ("nav", "footer", "aside"):
    CONTENT = f"regexp_replace({CONTENT}, '<{_tag}[^>]*>.*?</{_tag}>', '', 'gis')"


def duck_entities(expr: str) -> str:
    out = expr
    for ent, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = f"replace({out}, '&{ent};', '{ch}')"
    return out


def duck_text(expr: str) -> str:
    body = f"regexp_extract({expr}, '<body[^>]*>(.*?)(</body>|$)', 1, 'is')"
    return f"trim(regexp_replace({duck_entities(f"regexp_replace({body}, '</?[a-zA-Z!][^>]*>', '', 'g')")}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


LINKS = f"""anchors as (select page_id, url as page_url, unnest(regexp_extract_all({STRIP}, '<a [^>]*>[^<]*')) as a,
     unnest(range(len(regexp_extract_all({STRIP}, '<a [^>]*>[^<]*')))) as pos from pages),
 links as (select page_id, page_url, {duck_entities("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} as href,
     trim(regexp_replace({duck_entities("regexp_extract(a, '>(.*)$', 1)")}, '\\s+', ' ', 'g')) as anchor_text, pos as order_in_page,
     regexp_extract(page_url, '^(https?://[^/?#]*)', 1) as origin from anchors),
 abs_links as (select *, origin || {duck_encode('href', PATH_KEEP)} as target_url from links)"""


def page_links(t, *keep: str):
    return H.number_links(H.extract_links(t.pages, keep=("page_id", *keep)), "page_id")


def norm_pages(t):
    return U.normalize_url(t.pages.select("page_id", "url"), "url", "n")


# ---- sources --------------------------------------------------------------


@query("scan_pages", "select page_id, url, length(html) as n_chars from pages")
def _(t):
    pages = scan_pages(t.spark, f"{t.directory}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("n_chars"))


ROBOTS_CTES = """, lines as (select origin, unnest(string_split(text, chr(10))) as raw,
     unnest(range(len(string_split(text, chr(10))))) as line_no from robots),
 fields as (select origin, line_no, lower(trim(split_part(c, ':', 1))) as field, trim(regexp_replace(c, '^[^:]*:', '')) as value
   from (select origin, line_no, trim(regexp_replace(raw, '#.*$', '')) as c from lines) where c like '%:%'),
 marked as (select *, case when field = 'user-agent' and coalesce(lag(field) over (partition by origin order by line_no), '') <> 'user-agent'
     then 1 else 0 end as starts from fields where field <> 'sitemap'),
 grouped as (select *, sum(starts) over (partition by origin order by line_no) as g from marked),
 best as (select origin, g from (select origin, g, row_number() over (partition by origin order by
       case when value = '*' then 0 else length(value) end desc, line_no) as rn
     from grouped where field = 'user-agent' and (value = '*' or contains('loombot/1.0', lower(value)))) where rn = 1),
 chosen as (select c.* from grouped c join best b on b.origin = c.origin and b.g = c.g),
 delays as (select origin, max(cast(round(try_cast(value as double) * 1000) as bigint)) as crawl_delay_ms from chosen where field = 'crawl-delay' group by origin),
 rules as (select c.origin, c.field = 'allow' as allow, c.value as path,
     length(replace(replace(c.value, '*', ''), '$', '')) as weight, d.crawl_delay_ms
   from chosen c left join delays d on d.origin = c.origin where c.field in ('allow', 'disallow') and c.value <> '')"""
AGENT = "loombot/1.0"
RULE_RX = """(case when rule = '/' then '^' else '^' || replace(regexp_replace(regexp_replace(rule, '[$]$', ''),
   '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || case when rule like '%$' then '$' else '' end end)"""


@query("scan_robots", ROBOTS_CTES + " select origin, allow, path, weight, crawl_delay_ms from rules", "robots")
def _(t):
    return R.robots_rules(t.robots, AGENT).drop("line_no")


@query(
    "robots_allowed",
    ROBOTS_CTES
    + f""", target as (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as origin,
     case when regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) end
       || regexp_extract(url, '([?][^#]*)', 1) as tgt from pages),
 hits as (select t.page_id, r.weight, r.allow from target t join (select *, path as rule from rules) r on r.origin = t.origin
   where regexp_matches(t.tgt, {RULE_RX})),
 top as (select page_id, arg_max(allow, weight * 2 + cast(allow as int)) as allow from hits group by page_id)
 select p.page_id, coalesce(x.allow, true) as robots_allowed from pages p left join top x on x.page_id = p.page_id""",
    "robots",
)
def _(t):
    rules = R.robots_rules(t.robots, AGENT)
    return R.robots_allowed(t.pages.select("page_id", "url"), rules).select("page_id", "robots_allowed")


RULE_OF_PAGE = "case page_id % 6 when 0 then '/en/*.html$' when 1 then '/en' when 2 then '/' when 3 then '/*/5' when 4 then '/fr/1$' else '/d?/(x)' end"


@query(
    "robots_rule_match",
    f""", r as (select page_id, {RULE_OF_PAGE} as rule, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages)
 select page_id, rule, regexp_matches(path, {RULE_RX}) as matches, length(replace(replace(rule, '*', ''), '$', '')) as weight from r""",
)
def _(t):
    df = t.pages.select("page_id", F.expr(RULE_OF_PAGE).alias("rule"), U.url_path(F.col("url")).alias("path"))
    return df.select(
        "page_id", "rule", R.rule_matches(F.col("path"), F.col("rule")).alias("matches"), R.rule_weight(F.col("rule")).alias("weight")
    )


# ---- URLs -----------------------------------------------------------------


@query(
    "url_normalize",
    ", " + duck_norm("x", "pages", "url")
    + " select page_id, ident as identity_key, full_url as norm_url, host0 as host, nhost as normalized_host, path as pathname, search, frag as fragment, scheme as scope from x",
)
def _(t):
    n = F.col("n")
    return norm_pages(t).select(
        "page_id", n.identity_key.alias("identity_key"), n.url.alias("norm_url"), n.host.alias("host"),
        n.normalized_host.alias("normalized_host"), n.pathname.alias("pathname"), n.search.alias("search"),
        n.fragment.alias("fragment"), n["scope"].alias("scope"),
    )


VARIANT = """case page_id % 3 when 0 then replace(url, '://', '://www.') when 1 then regexp_replace(url, '#.*$', '') || '#other'
  else regexp_replace(url, '[?#].*$', '') || '/?utm_medium=q' end"""


@query(
    "same_identity",
    f", v as (select page_id, url, {VARIANT} as url2 from pages), "
    + duck_norm("x", "v", "url") + ", y0 as (select page_id, ident as i1, url2 from x), " + duck_norm("y", "y0", "url2")
    + " select page_id, i1 = ident as same from y",
)
def _(t):
    df = t.pages.select("page_id", "url", F.expr(VARIANT).alias("url2"))
    df = U.normalize_url(U.normalize_url(df, "url", "a"), "url2", "b")
    return df.select("page_id", U.same_identity(F.col("a.identity_key"), F.col("b.identity_key")).alias("same"))


SCOPE_COLS = """case when page_id % 2 = 0 then 'example.com' else regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(www|blog|m)[.]', '') end as root_host,
  case page_id % 4 when 0 then 'same_domain' when 1 then 'same_site' when 2 then 'allowlist' else 'all' end as rule"""


@query(
    "scope_filter",
    f", v as (select page_id, url, {SCOPE_COLS} from pages), " + duck_norm("x", "v", "url")
    + """ select page_id, ident as identity_key from x where rule = 'all' or nhost = root_host
      or (rule in ('same_site', 'allowlist') and ends_with(nhost, '.' || root_host))
      or (rule = 'allowlist' and ((ends_with(nhost, '.example.org') and nhost <> 'example.org') or nhost = 'thther.example.net'))""",
)
def _(t):
    df = t.pages.selectExpr("page_id", "url", *SCOPE_COLS.split(",\n"))
    df = U.normalize_url(df, "url", "n")
    allow = F.array(F.lit(".*.example.org"), F.lit(" THTHER.example.net"))
    # a pattern loses one leading dot, so '.*.example.org' reads '*.example.org'
    keep = U.in_scope(F.col("n.normalized_host"), F.col("root_host"), F.col("rule"), allow)
    return df.filter(keep).select("page_id", F.col("n.identity_key").alias("identity_key"))


@query(
    "extract_links",
    ", " + LINKS + " select page_id, order_in_page, href, target_url as link_url, anchor_text, false as is_nofollow from abs_links",
)
def _(t):
    return page_links(t).select(
        "page_id", "order_in_page", "href", F.col("url").alias("link_url"), "anchor_text", "is_nofollow"
    )


HREF_KIND = "(page_id + order_in_page) % 4"


@query(
    "resolve_href",
    ", " + LINKS
    + f""", r as (select *, {duck_encode('href', PATH_KEEP)} as enc, regexp_extract(page_url, '^https?://[^/?#]*([^?#]*)', 1) as bp,
     regexp_extract(page_url, '^(https?:)', 1) as sch from links)
 select page_id, order_in_page, case {HREF_KIND} when 0 then origin || enc
   when 1 then origin || regexp_replace(bp, '[^/]*$', '') || substr(enc, 2)
   when 2 then sch || '//cdn.example.com' || enc else origin || bp || '?q=1&r=' || cast(order_in_page as varchar) end as resolved from r""",
)
def _(t):
    links = H.number_links(
        H.extract_links(t.pages.withColumn("page_url", F.col("url")), keep=("page_id", "page_url")), "page_id"
    )
    kind = F.expr(HREF_KIND)
    href = (
        F.when(kind == 0, F.col("href"))
        .when(kind == 1, F.substring("href", 2, 1 << 30))
        .when(kind == 2, F.concat(F.lit("//CDN.example.com"), F.col("href")))
        .otherwise(F.concat(F.lit("?q=1&r="), F.col("order_in_page").cast("string")))
    )
    df = links.select("page_id", "order_in_page", "page_url", href.alias("h"))
    return U.absolute_url(df, "page_url", "h", "resolved").select("page_id", "order_in_page", "resolved")


ASSET_URL = "regexp_replace(url, '[?#].*$', '') || case page_id % 5 when 0 then '.PNG' when 1 then '.pdf?x=.html' when 2 then '.html?f=a.zip' when 3 then '.tar.gz' else '.jpegs' end"


@query("asset_filter", f"select page_id, page_id % 5 in (0, 1, 3) as is_asset from pages")
def _(t):
    return t.pages.select("page_id", U.is_asset_url(F.expr(ASSET_URL)).alias("is_asset"))


CT = "case page_id % 8 when 0 then 'text/html; charset=utf-8' when 1 then 'image/PNG' when 2 then 'application/pdf' when 3 then 'application/xhtml+xml' when 4 then 'text/plain' when 5 then 'application/json' when 6 then 'font/woff2' end"


@query(
    "content_type_class",
    "select page_id, case when page_id % 8 in (1, 2, 6) then 'asset' when page_id % 8 = 5 then 'other' else 'html' end as class from pages",
)
def _(t):
    return t.pages.select("page_id", H.content_class(F.expr(CT)).alias("class"))


@query(
    "render_decision",
    f"""select page_id, len(regexp_extract_all(html, '<script')) as script_count,
      len(regexp_extract_all(html, '<a href="/')) as link_count, length({duck_text(STRIP)}) as text_length,
      case when page_id % 7 = 0 then 'static-error' when len(regexp_extract_all(html, '<a href="/')) = 0 then 'no-links-fallback'
        else 'static-enough' end as render_decision from pages""",
)
def _(t):
    df = H.render_features(t.pages.withColumn("static_ok", F.col("page_id") % 7 != 0))
    return H.render_decision(df).select("page_id", "script_count", "link_count", "text_length", "render_decision")


PROBE = f"page_id % 9 <> 0 as reachable, page_id % 4 < 2 as is_html, case when page_id % 3 = 0 then 404 else 200 end as http_status, {CT} as content_type"


@query(
    "probe_classify",
    f""", p as (select page_id, {PROBE} from pages)
 select page_id, case when not reachable then 'error' when is_html and http_status < 400 then 'ok' when is_html then 'error'
   when content_type is null then 'queued' else 'error' end as probe_status,
   not reachable or is_html or content_type is null as accept from p""",
)
def _(t):
    return S.probe_status(t.sql(f"select page_id, {PROBE} from {{pages}}")).select("page_id", "probe_status", "accept")


LABEL_COLS = "case when page_id % 5 = 0 then ' al ' || cast(page_id as string) when page_id % 5 = 1 then '  ' end as alias, case when page_id % 3 = 0 then 'Title ' end as title"


@query(
    "display_label",
    f", v as (select page_id, url, {LABEL_COLS} from pages), " + duck_norm("x", "v", "url")
    + """ select page_id, coalesce(nullif(trim(alias), ''), nullif(trim(title), ''),
      case when path = '/' then nhost else url_decode(regexp_extract(path, '([^/]*)$', 1)) end) as label from x""",
)
def _(t):
    df = U.normalize_url(t.sql(f"select page_id, url, {LABEL_COLS} from {{pages}}"), "url", "n")
    return df.select("page_id", U.display_label(F.col("alias"), F.col("title"), F.col("n"), F.col("url")).alias("label"))


TITLE = f"trim({duck_entities("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")})"


@query(
    "extract_content",
    f"select page_id, nullif({TITLE}, '') as title, length({duck_text(CONTENT)}) as text_length, md5({duck_text(CONTENT)}) as text_md5 from pages",
)
def _(t):
    df = H.extract_content(t.pages.select("page_id", "html"))
    return df.select("page_id", "title", "text_length", F.md5("text").alias("text_md5"))


FP = "case when length(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) >= 64 then sha256(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) end"


@query("content_fingerprint", f"select doc_id, {FP.format('text')} as fingerprint from documents")
def _(t):
    return t.documents.select("doc_id", H.content_fingerprint(F.col("text")).alias("fingerprint"))


PAGED_URL = "case when page_id % 3 = 0 then regexp_replace(url, '[?#].*$', '') || '/page/' || cast(page_id as string) when page_id % 3 = 1 then regexp_replace(url, '[?#].*$', '') || '?z=1&offset=' || cast(page_id as string) || '&b=2' else url end"
PAGED = f""", v as (select page_id, {PAGED_URL} as u from pages),
 w as (select page_id, u, regexp_extract(u, '^(https?://[^/?#]+)', 1) as origin, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) as path from v),
 pg as (select page_id, regexp_extract(u, '^https?://([^/?#]+)', 1) as site_id, case when page_id % 3 = 0 or page_id % 3 = 1 then page_id when u like '%?page=2%' then 2 end as page_number,
   case when page_id % 3 = 0 then origin || regexp_replace(path, '/page/[0-9]+$', '') || '|path'
     when page_id % 3 = 1 then origin || path || '?b=2&z=1|query:offset'
     when u like '%?page=2%' then origin || path || '?ref=x|query:page' end as series_key from w)"""


def _paged(t):
    df = t.sql(f"select page_id, {PAGED_URL} as u from {{pages}}")
    return U.pagination(df, "u", "pg").select(
        "page_id", F.regexp_extract("u", "^https?://([^/?#]+)", 1).alias("site_id"), "pg.page_number", "pg.series_key"
    )


@query("detect_pagination", PAGED + " select page_id, page_number, series_key from pg")
def _(t):
    return _paged(t).drop("site_id")


@query("pagination_series", PAGED + " select site_id, series_key, count(*) as pages from pg where series_key is not null group by all")
def _(t):
    return S.pagination_series(_paged(t))


PREFIX = ", " + duck_norm("x", "pages", "url") + """, seg as (select page_id, nhost, list_filter(string_split(path, '/'), lambda s: s <> '') as s from x),
 pre as (select page_id, nhost as site_id, unnest(list_transform(range(1, len(s) + 1), lambda i: '/' || array_to_string(s[1:i], '/'))) as prefix from seg)"""


@query("path_prefixes", PREFIX + " select page_id, prefix from pre")
def _(t):
    return norm_pages(t).select("page_id", F.explode(U.path_prefixes(F.col("n.pathname"))).alias("prefix"))


@query("prefix_hits", PREFIX + " select site_id, prefix, count(*) as hits, count(*) > 3 as pruned from pre group by all")
def _(t):
    pages = norm_pages(t).select(F.col("n.normalized_host").alias("site_id"), F.col("n.pathname").alias("pathname"))
    return G.prefix_hits(pages, threshold=3)


@query("out_link_count", ", " + LINKS + " select page_id, count(*) as out_link_count from links group by page_id")
def _(t):
    return S.out_link_count(H.extract_links(t.pages, keep=("page_id",)), "page_id")


# ---- flagship slice: in-scope link targets per host -----------------------


@query(
    "host_link_targets",
    ", " + LINKS + ", " + duck_norm("x", "abs_links", "target_url")
    + """ select nhost as host, ident as target, count(*) as links, count(distinct page_id) as pages from x group by all""",
)
def host_link_targets(t):
    """Per host, in-scope link targets with the number of links and of linking pages."""
    pages = U.normalize_url(t.pages.select("page_id", "url", "html"), "url", "p")
    links = H.extract_links(pages.withColumn("page_host", F.col("p.normalized_host")), keep=("page_id", "page_host"))
    links = U.normalize_url(links.select("page_id", "page_host", "url"), "url", "n")
    kept = links.filter(U.in_scope(F.col("n.normalized_host"), F.col("page_host"), F.lit("same_site"), F.lit(None).cast("array<string>")))
    per_page = kept.groupBy(F.col("n.normalized_host").alias("host"), F.col("n.identity_key").alias("target"), "page_id").agg(F.count("*").alias("c"))
    return per_page.groupBy("host", "target").agg(F.sum("c").alias("links"), F.count("*").alias("pages"))


# ---- archive and logs -------------------------------------------------------


@query(
    "archive_parsed",
    f""", d as (select page_id, html, nullif({TITLE}, '') as title, {duck_text(CONTENT)} as text from pages)
 select cast(page_id as varchar) as node_id, title, length(text) as text_length, {FP.format('text')} as content_hash,
   md5(text) as excerpt_md5, 'raw/' || page_id || '.html' as raw_rel_path, octet_length(encode(html)) as bytes, sha256(html) as sha256 from d""",
)
def _(t):
    pages = t.pages.select(F.lit("s").alias("site_id"), F.col("page_id").cast("string").alias("node_id"), "url", "html")
    parsed, files = X.archive_pages(pages, store_raw=True)
    raw = files.filter(F.col("kind") == "html").select("node_id", "bytes", "sha256")
    return parsed.join(raw, "node_id").select(
        "node_id", "title", "text_length", "content_hash", F.md5("text_excerpt").alias("excerpt_md5"), "raw_rel_path", "bytes", "sha256"
    )


@query(
    "append_fetch_log",
    'select id, task_id, node_id, http_status, duration_ms, error, cast(to_json(redirect_chain) as varchar) as redirect_chain, "at" from fetch_logs',
    "fetch_logs",
)
def _(t):
    path = new_path(t.spark, "fetch-logs")
    logs = t.fetch_logs.select("id", "task_id", "node_id", "http_status", "duration_ms", "error", "redirect_chain", "at")
    append_fetch_logs(logs, path)
    return t.spark.read.schema(fetch_log_rows(logs).schema).parquet(path)
