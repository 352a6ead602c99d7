"""Operator 4 against a plain version."""

import duckdb

from inkframe.llm import queries, urls

RULES = urls.RULES


def plain(pages, rounds=8, damping=0.85):
    import re

    low = str.maketrans(urls.UPPER, urls.LOWER)
    out, links, n = {}, set(), {}
    for i, (page, url, html) in enumerate(pages):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(low)
        fits = [(len(r), r, v) for v, r in RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        out[i] = [page, host, path, best[1], best[2]]
        for target in re.findall(urls.LINK, html or ""):
            if host and target.translate(low) != host:
                links.add((host, target.translate(low)))
        k = n.setdefault(host, [0, 0, 0])
        k[0] += 1
        k[1] += best[2] == "allow"
        k[2] += best[2] == "block"
    scores = []
    for which, edges in ((1, links), (2, {(b, a) for a, b in links})):
        seeds = {h: k[which] / k[0] for h, k in n.items() if k[which]}
        degree = {}
        for a, _ in edges:
            degree[a] = degree.get(a, 0) + 1
        rank = dict(seeds)
        for _ in range(rounds):
            new = {h: r * (1 - damping) for h, r in seeds.items()}
            for a, b in edges:
                if a in rank:
                    new[b] = new.get(b, 0) + rank[a] / degree[a] * damping
            rank = new
        scores.append(rank)
    for row in out.values():
        if row[4] is None:
            row[4] = "block" if scores[1].get(row[1], 0) > scores[0].get(row[1], 0) else "allow"
    return sorted((tuple(r) for r in out.values()), key=str)


PAGES = [
    (1, "http://A.Example.org/es/1?x", '<a href="http://good.net/x">'),
    (2, "https://example.org/en/12#t", "<A HREF='//far.net'> <a href=/local>"),
    (3, "http://example.org/en/2", None),
    (4, "http://shop.com/fr/1", '<a href="https://good.net?q=1"> <a href="https://GOOD.net">'),
    (5, "http://bad.com/de/1", '<a href="http://x.net">'),
    (6, "http://bad.com/en/1", ""),
    (7, "http://linker.net/", '<a href="http://bad.com/de/9"><a href=http://also.net/>'),
    (8, "http://also.net/a", '<a href="http://linker.net/">'),
    (9, "http://good.net/", None),
    (10, None, "//x.net"),
    (11, "no scheme", '<a href="http://bad.com/">'),
    (12, "http://org", None),
    (13, "http://a.org?x=/y", None),
    (14, "http://notexample.org/es/", None),
    (15, "ftp://u@h.com:80/de/../a://b/c\nd?e", None),
    (16, "http://far.net", None),
    (None, "http://x.net/1", None),
    (4, "http://shop.com/fr/1", None),
]
PLAIN = "page_id long, url string, html string, host string, rule int"


def test_rules_and_propagation(spark):
    df = spark.createDataFrame([(*p, "h", 1) for p in PAGES], PLAIN)
    got = sorted((tuple(r)[:5] for r in urls.judge(df).collect()), key=str)
    assert got == plain(PAGES)
    by = {r[0]: r[4] for r in got}
    assert by[6] == "block" and by[7] == "block" and by[9] == "allow" and by[16] == "allow"


def test_none(spark):
    assert urls.judge(spark.createDataFrame([], PLAIN)).collect() == []


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert sorted(con.execute(urls.oracle()).fetchall(), key=str) == plain(PAGES)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op4_url_filter(spark, sf).collect()), key=str) == plain(rows)


def test_a_hundred_thousand_rules(spark):
    """The longest of many rules, of one host with many paths and of many hosts; very long urls; the first of equal rules."""
    rules = [("block", f"hot.org/{i}/") for i in range(50_000)] + [("allow", f"h{i}.net/") for i in range(50_000)] + [("allow", "hot.org/7/good"), ("block", "org/"), ("allow", "org/"), ("allow", "x.h5.net/a"), ("block", "xx.h5.net/")]
    pages = [(i, f"http://www.hot.org/{i * 3}/x{'y' * (i % 5)}", None) for i in range(2_000)] + [(3_000, "https://hot.org/7/good/1", None), (3_001, "http://a.x.h5.net/abc", None), (3_002, "http://h49999.net/" + "p" * 300_000, None), (3_003, "http://hot.org", None), (3_004, "http://xx.h5.net/", None), (3_005, "http://other.org/1", None)]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert len(got) == len(pages)
    assert all(got[i] == (f"hot.org/{3 * i}/", "block") for i in range(2_000))
    assert got[3_000] == ("hot.org/7/good", "allow") and got[3_001] == ("x.h5.net/a", "allow") and got[3_002] == ("h49999.net/", "allow")
    assert got[3_003][0] is None and got[3_004] == ("xx.h5.net/", "block") and got[3_005] == ("org/", "block")
    table = spark.createDataFrame(rules, "verdict string, rule string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, table).collect()}.keys() == got.keys()
