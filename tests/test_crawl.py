"""The level-wise crawl against a one-worker queue written in plain Python."""

import random
import re

import pytest

from linkloom.options import CrawlOptions
from linkloom.plans.crawl import crawl_graph
from linkloom.sources.robots import robots_rules

ORIGIN = "https://s.example.com"
FILLER = "This filler text is long enough for a fingerprint to be taken of the page. "


def page(title, body):
    return f"<html><head><title>{title}</title></head><body><main>{FILLER}{body}</main></body></html>"


def anchors(*hrefs):
    return "".join(f'<a href="{h}">{h}</a>' for h in hrefs)


def crawl(spark, rows, origins, opts, robots):
    pages = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string, http_status int, content_type string"
    )
    sites = spark.createDataFrame(
        [(o, o + "/", "same_site", None) for o in origins], "id string, root_url string, scope string, allowlist array<string>"
    )
    rules = robots_rules(spark.createDataFrame([(o, robots) for o in origins], "origin string, text string"), "bot")
    nodes, edges = crawl_graph(pages, sites, rules, opts)
    return nodes.collect(), edges.collect()


def strip(url, origin):
    url = url.split("#")[0]
    path, _, query = url.partition("?")
    path = path.rstrip("/")
    if path == origin:
        path += "/"
    return path + ("?" + query if query else "")


def model(rows, origin, opts, blocked=()):
    """One worker, one queue."""
    store = {}
    for url, html, status, ctype in rows:
        store.setdefault(strip(url, origin), (html, status, ctype))
    nodes = {origin + "/": dict(depth=0, parent=None, status="queued")}
    queue, edges, texts, hits, pruned, series = [origin + "/"], set(), set(), {}, set(), {}
    fetched = 0
    while queue:
        queue.sort(key=lambda k: nodes[k]["depth"])  # stable: shallow first, then first queued
        key = queue.pop(0)
        node = nodes[key]
        if opts.max_pages is not None and fetched >= opts.max_pages:
            node["status"] = "skipped"
            break
        path = key[len(origin):].split("?")[0]
        if re.search(r"\.(png|pdf)$", path):
            node["status"] = "skipped"
            continue
        if any(key[len(origin):].startswith(b) for b in blocked):
            node["status"] = "blocked"
            continue
        if key not in store:
            continue
        html, status, ctype = store[key]
        fetched += 1
        if "image/" in ctype:
            node["status"] = "skipped"
            continue
        if status >= 400:
            node["status"] = "error"
            continue
        text = re.sub("[^a-z0-9]+", "", re.sub("<[^>]*>", "", re.search("<body>(.*)", html).group(1)).lower())
        if len(text) >= 64:
            if text in texts:
                node["status"] = "skipped"
                continue
            texts.add(text)
        for href in re.findall('<a href="([^"]*)"', html):
            url = href if href.startswith("http") else origin + href
            if not url.startswith(origin):
                continue
            target, frag = strip(url, origin), (url.split("#") + [None])[1]
            if node["depth"] + 1 > opts.max_depth:
                continue
            seg = re.match(r"/[^/?]+", target[len(origin):])
            if seg and seg.group(0) in pruned:
                continue
            if (m := re.match(r"(.*)\?page=\d+$", target)) is not None:
                if series.get(m.group(1), 0) >= opts.pagination_page_limit:
                    continue
                series[m.group(1)] = series.get(m.group(1), 0) + 1
            if target not in nodes:
                nodes[target] = dict(depth=node["depth"] + 1, parent=key, status="queued")
                queue.append(target)
            edges.add((key, target, frag))
        node["status"] = "ok"
        seg = re.match(r"/[^/?]+", key[len(origin):])
        if seg:
            hits[seg.group(0)] = hits.get(seg.group(0), 0) + 1
            if hits[seg.group(0)] > opts.prefix_prune_threshold:
                pruned.add(seg.group(0))
    return nodes, edges


def compare(spark, by_origin, opts, robots, blocked):
    """Several sites in one crawl, each against its own model."""
    rows = [r for site in by_origin.values() for r in site]
    nodes, edges = crawl(spark, rows, list(by_origin), opts, robots)
    keys = {n.id: n.identity_key for n in nodes}
    assert len({(n.site_id, n.identity_key) for n in nodes}) == len(nodes) == len(keys)
    results = {}
    for origin, site in by_origin.items():
        got = {
            n.identity_key: dict(depth=n.depth, parent=keys.get(n.auto_parent_id), status=n.status)
            for n in nodes
            if n.site_id == origin
        }
        want_nodes, want_edges = model(site, origin, opts, blocked)
        assert got == want_nodes
        assert {(keys[e.from_id], keys[e.to_id], e.fragment) for e in edges if e.site_id == origin} == want_edges
        results[origin] = got
    return results


def orchard(o):
    """A chain of pages, a hub that is reached twice, a copy, a long series and dead ends."""
    rows = [("/", page("Gate", "gate" + anchors("/rows/1", "/barn", "/no/well", "/press.pdf", "/gone", "/crop?page=1")))]
    rows += [(f"/rows/{i}", page(f"Row {i}", f"row {i}" + anchors(f"/rows/{i + 1}", "/barn#door"))) for i in range(1, 7)]
    rows += [("/barn", page("Barn", "barn" + anchors("/loft/", "/loft#hay", "/copy", "/"))), ("/loft", page("Loft", "loft" + anchors("/rows/3")))]
    rows += [("/copy", page("Other title", "barn" + anchors("/loft/", "/loft#hay", "/copy", "/")))]
    rows += [(f"/crop?page={i}", page("Crop", f"crop {i}" + anchors(f"/crop?page={i + 1}"))) for i in range(1, 7)]
    return [(o + u, h, 200, "text/html") for u, h in rows] + [(o + "/gone", page("x", "x"), 410, "text/html")]


def random_site(o, seed):
    rnd = random.Random(seed)
    names = [f"/sec{rnd.randint(0, 3)}/p{i}" for i in range(90)] + [f"/list{k}?page={i}" for k in range(3) for i in range(12)]
    names += [f"/img{i}.png" for i in range(5)] + [f"/no/{i}" for i in range(6)]
    rows = [("/", page("root", anchors(*rnd.sample(names, 12))), 200, "text/html")]
    for n in names:
        links = [rnd.choice(names) + rnd.choice(["", "", "#a", "#b"]) for _ in range(rnd.randint(0, 7))]
        body = "same words" if rnd.random() < 0.15 else n.replace("/", " ").replace("?", " ")
        kind = rnd.random()
        status, ctype = (404, "text/html") if kind < 0.08 else (200, "image/png") if kind < 0.12 else (200, "text/html")
        # anchors hold no text, so copies differ only in links
        rows.append((n, page(n, body + "".join(f'<a href="{x}"></a>' for x in links)), status, ctype))
    return [(o + u, *rest) for u, *rest in rows]


ROBOTS = "User-agent: *\nDisallow: /no/\n"


def test_sites_match_one_worker(spark):
    other = "https://other.example.net"
    opts = CrawlOptions(max_depth=4, prefix_prune_threshold=6, pagination_page_limit=2)
    got = compare(spark, {ORIGIN: orchard(ORIGIN), other: random_site(other, 1)}, opts, ROBOTS, ("/no/",))[ORIGIN]
    at = lambda path: (got[ORIGIN + path]["depth"], got[ORIGIN + path]["status"])
    assert at("/barn") == (1, "ok") and at("/rows/4") == (4, "ok") and ORIGIN + "/rows/5" not in got
    assert at("/copy") == (2, "skipped") and at("/gone") == (1, "error") and at("/no/well") == (1, "blocked")
    assert got[ORIGIN + "/rows/3"]["parent"] == ORIGIN + "/rows/2" and sum("/crop" in k for k in got) == 2


def test_budgets_that_are_off(spark):
    opts = CrawlOptions(max_depth=130, max_pages=None, visit_limit=None, prefix_prune_threshold=None, pagination_page_limit=None)
    deep = [(ORIGIN + ("/" if i == 0 else f"/d/{i}"), page(f"{i}", f"depth {i}" + anchors(f"/d/{i + 1}")), 200, "text/html") for i in range(5)]
    nodes, _ = crawl(spark, deep, [ORIGIN], opts, "")
    assert sorted((n.depth, n.status) for n in nodes) == [(i, "ok") for i in range(5)] + [(5, "queued")]


def test_depth_zero_is_the_roots(spark):
    nodes, edges = crawl(spark, orchard(ORIGIN), [ORIGIN], CrawlOptions(max_depth=0), "")
    assert [(n.identity_key, n.status) for n in nodes] == [(ORIGIN + "/", "ok")] and edges == []


def test_options_are_not_bent():
    assert CrawlOptions(max_depth=500, max_pages=50_000_000).max_pages == 50_000_000
    for bad in (dict(max_depth=-1), dict(max_pages=0), dict(visit_limit=0), dict(max_depth=None)):
        with pytest.raises(ValueError):
            CrawlOptions(**bad)


def test_page_limit_matches_one_worker(spark):
    other = "https://other.example.net"
    opts = CrawlOptions(max_depth=3, max_pages=40, prefix_prune_threshold=6, pagination_page_limit=4)
    compare(spark, {ORIGIN: random_site(ORIGIN, 2), other: random_site(other, 3)[:30]}, opts, ROBOTS, ("/no/",))


def test_redirect_takes_free_identity(spark):
    pages = spark.createDataFrame(
        [
            (0, ORIGIN + "/", page("r", anchors("/old", "/taken", "/gone")), ORIGIN + "/"),
            (1, ORIGIN + "/old", page("old", "moved here" + anchors("sub")), ORIGIN + "/dir/new"),
            (2, ORIGIN + "/taken", page("t", "taken text"), ORIGIN + "/taken"),
            (3, ORIGIN + "/gone", page("g", "gone text"), ORIGIN + "/taken"),
        ],
        "page_id long, url string, html string, final_url string",
    )
    sites = spark.createDataFrame([("s", ORIGIN, "same_site", None)], "id string, root_url string, scope string, allowlist array<string>")
    nodes, _ = crawl_graph(pages, sites, opts=CrawlOptions(max_depth=2))
    got = {r.identity_key: r.url for r in nodes.collect()}
    assert got[ORIGIN + "/dir/new"] == ORIGIN + "/dir/new" and ORIGIN + "/old" not in got
    assert ORIGIN + "/dir/sub" in got
    assert got[ORIGIN + "/gone"] == ORIGIN + "/taken" and ORIGIN + "/taken" in got
