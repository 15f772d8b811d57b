import re
from collections import defaultdict

import pytest

from trailspark.llm import urltree as u

URLS = [
    "http://A.example.COM/en/1?x=/en/", "https://www.example.com/en/2#t", "http://x.net/es/a", "http://net/fr/", "ftp://es.net/de/1", "no scheme",
    None, "", "://", "http://", "http://host", "http://host?q=1", "http://ÀB.org/Ä/b", "x://y://z/w", "http://example.com/english", "http://notexample.com/en/1",
    "http://example.com", "http://example.com/", "http://a.example.org/v/w/x/y/z/1/2/3", "http://x.net\nb/es/1",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules=u.RULES):
    fits = [(len(h + p), h + p, kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def frame(spark, rows, labels):
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS template", "2 AS good").repartition(2)
    return pages, spark.createDataFrame(labels, "page_id long, good int")


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://x.net/es/a"), (3, URLS[3])]
    found = u.judge_urls(*frame(spark, rows, [])).collect()
    assert len(found) == len(rows)
    for r in found:
        url = "http://x.net/es/a" if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path) == plain(url)
        rule, kind = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (kind or "allow")


def grow(paths, depth=u.DEPTH, fanout=u.FANOUT, z=u.Z_SQUARED):
    """The tree by plain loops; paths: {(host, typed): [pages, labelled, good]}."""
    at = {key: "" for key in paths}
    for level in range(depth + 1):
        children = defaultdict(lambda: [0, 0, 0])
        for (host, typed), n in paths.items():
            parts = typed.split("/") if typed else []
            if level < len(parts):
                c = children[host, at[host, typed], parts[level]]
                for k in range(3):
                    c[k] += n[k]
        nodes = defaultdict(lambda: [0, 0, 0, 0])
        for (host, t, _), c in children.items():
            nodes[host, t] = [a + b for a, b in zip(nodes[host, t], [1, *c])]
        for (host, typed) in paths:
            parts = typed.split("/") if typed else []
            if level < len(parts):
                t, s = at[host, typed], parts[level]
                (n, l, g), (branches, pages, labelled, good) = children[host, t, s], nodes[host, t]
                if branches > fanout and n * fanout < pages:
                    s = "{*}"
                elif branches > 1 and (g * labelled - l * good) ** 2 <= z * l * good * (labelled - good):
                    s = "{~}"
                at[host, typed] = t + "/" + s
    return at


def typed(path):
    parts = [s for s in path.split("/") if s]
    kinds = ["{n}" if re.fullmatch("[0-9]+", s) else "{s}" if re.search("[0-9]", s) else s for s in parts[: u.DEPTH]]
    return "/".join(kinds + ["{**}"] * (len(parts) > u.DEPTH))


def test_verdicts_equal_plain_loops(spark):
    rows, labels = [], []
    for i in range(600):
        section = ["spam", "blog", "news", f"name{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3}"][i % 4]
        rows.append((i, f"http://h{i % 3}.org/{section}/{['x', str(i), 'p' + str(i)][i % 3]}" + "/q" * (i % 9)))
        if i % 2 == 0:
            labels.append((i, int(not (section == "spam" and i % 3 == 0) and i % 20 != 0)))
    labels += [(0, 0), (4, None), (9999, 1)]
    found = {r.page_id: r for r in u.judge_urls(*frame(spark, rows, labels)).collect()}
    known = {}
    for page, good in labels:
        if good is not None:
            known[page] = min(good, known.get(page, 1))
    paths = defaultdict(lambda: [0, 0, 0])
    for page, url in rows:
        n = paths[plain(url)[0], typed(plain(url)[1])]
        n[0] += 1
        n[1] += page in known
        n[2] += known.get(page, 0)
    at = grow(paths)
    hosts, trees = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (host, t), (_, l, g) in paths.items():
        for sums in (hosts[host], trees[host, at[host, t]]):
            sums[0] += l
            sums[1] += g
    overall = (sum(h[1] for h in hosts.values()) + 1) / (sum(h[0] for h in hosts.values()) + 2)
    for page, url in rows:
        host, path = plain(url)
        template = at[host, typed(path)]
        prior = (hosts[host][1] + u.SMOOTHING * overall) / (hosts[host][0] + u.SMOOTHING)
        purity = (trees[host, template][1] + u.SMOOTHING * prior) / (trees[host, template][0] + u.SMOOTHING)
        assert (found[page].template, found[page].verdict) == (template, "block" if purity < 0.5 else "allow")
    blocked = [p for p, r in found.items() if r.verdict == "block"]
    assert blocked and all("/spam/" in rows[p][1] for p in blocked)


def test_no_pages_and_native_plan(spark, sf_dir):
    pages, labels = frame(spark, [(1, "http://a/b")], [(1, 1)])
    assert u.judge_urls(pages.limit(0), labels).count() == 0
    plan = u.op10_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "ExistingRDD") if w in plan]


def test_query_rules_on_the_table(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in u.op10_url_filters(spark, sf_dir).collect():
        rule, kind = plain_rule(*plain(urls[r.page_id]))
        assert (r.host, r.path) == plain(urls[r.page_id]) and r.rule == rule and r.verdict in ([kind] if kind else ["allow", "block"])


@pytest.mark.parametrize("sections", [16, 20])
@pytest.mark.parametrize("rare", [0, 1])
def test_small_sections_keep_their_own_verdict(spark, sections, rare):
    urls = [f"http://h.org/sec{'abcdefghijklmnopqrst'[i % sections]}/{i}" for i in range(20 * sections)]
    labels = [(i, rare if "seca" in url else 1 - rare) for i, url in enumerate(urls) if i < 15 * sections]
    for r in u.judge_urls(*frame(spark, list(enumerate(urls)), labels)).collect():
        assert r.verdict == ("allow" if (r.path.startswith("/seca/")) == bool(rare) else "block")


@pytest.mark.parametrize("deep", [5, 6, 7, 12])
def test_branches_part_at_any_level(spark, deep):
    base = "http://h.org" + "/q" * deep
    ends = ["/spam/x", "/good/x", "/good/y", "/good", "", "/good/x/v/w"]
    rows = [(i, base + ends[i % 6]) for i in range(240)] + [(1000 + i, base + "/q" * (i % 5)) for i in range(50)]
    found = u.judge_urls(*frame(spark, rows, [(i, int(i % 6 != 0)) for i in range(180)])).collect()
    assert len(found) == len(rows) and {r.page_id for r in found if r.verdict == "block"} == set(range(0, 240, 6))
