import duckdb

from convlens.llm import url_rules as ur

LINK = '<html><link rel="canonical" href="{}"/></html>'
PAGES = [
    (1, "http://a.example.org/es/x", None), (2, "https://EXAMPLE.org/en/12?q", ""), (3, "http://x.org", "t"), (4, "http://x.org/", "t"),
    (5, "https://shop.com/de/a#f", "t"), (6, "http://shop.com/de/a", "t"), (7, "http://other.net/p", LINK.format("https://shop.com/de/a")),
    (8, "http://far.net/q", '<meta http-equiv="refresh" content="0; url=http://other.net/p">'), (9, None, LINK.format("http://shop.com/de/")),
    (10, "no scheme", "t"), (11, "http://", "t"), (12, "http://both.net/", LINK.format("http://shop.com/de/a")),
    (13, "http://y.net/1", LINK.format("http://z.net/2")), (14, "http://z.net/2", LINK.format("http://k.com/de/5")), (15, "http://w.net/3", LINK.format("http://y.net/1")),
    (16, "http://m.k.com/fr/1", LINK.format("http://w.net/3")), (17, "http://notorg/", "t"), (18, "ftp://u@EXAMPLE.ORG:80/es/", "t"), (None, "http://q.org/a", "t"),
    (7, "http://other.net/p", "t"), (19, "x://a.com/frx", "t"), (20, "http://k.com/de/5", LINK.format("/relative")),
]


def test_verdicts_and_sql(spark, rows):
    pages = rows([(*p, "c") for p in PAGES], "page_id long, url string, html string, component string")
    rules = spark.createDataFrame(ur.RULES, "host string, path string, verdict string")
    got = [tuple(r) for r in ur.judge(pages, rules, ur.alias_edges(pages)).collect()]
    by = {g[0]: g for g in got}
    assert by[1] == (1, "a.example.org", "/es/x", "example.org/es/", "block")
    assert by[2][1:] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert by[3][3:] == (None, "allow") and by[4][3:] == ("org/", "allow")
    assert by[7][3:] == (None, "block") and by[8][3:] == (None, "block") and by[12][3:] == (None, "block")
    # one member of the component is explicitly allowed: unruled aliases are allowed, ruled ones keep their rule
    assert by[13][4] == by[14][4] == by[15][4] == "allow" and by[16][3:] == ("com/fr/", "allow") and by[20][3:] == ("com/de/", "block")
    assert by[9][1:] == by[10][1:] == ("", "", None, "allow")
    db = duckdb.connect()
    db.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(got, key=repr) == sorted(db.execute(ur.OP10_SQL).fetchall(), key=repr)


def test_no_edges_no_rows(spark, rows):
    rules = spark.createDataFrame(ur.RULES, "host string, path string, verdict string")
    assert ur.judge(rows([], "page_id long, url string"), rules).count() == 0
    assert ur.judge(rows([(1, "http://a.org/")], "page_id long, url string"), rules.limit(0)).collect()[0]["verdict"] == "allow"


def test_targets_that_are_no_pages(spark, rows):
    data = [
        (1, "http://m.net/1", LINK.format("http://shop.com/de/zzz")), (2, "http://m.net/2", LINK.format("http://gone.net/x")),
        (3, "http://m.net/3", '<meta http-equiv="refresh" content="0; url=http://gone.net/x">'), (4, "http://shop.com/de/1", LINK.format("http://gone.net/x")),
        (5, "http://n.net/5", LINK.format("http://a.org/ok")), (6, "http://n.net/6", LINK.format("http://n.net/5")), (7, "http://n.net/6", LINK.format("http://shop.com/de/q?x")),
        (8, "http://o.net/8", "t"),
    ]
    pages = rows(data, "page_id long, url string, html string")
    rules = spark.createDataFrame(ur.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in ur.judge(pages, rules, ur.alias_edges(pages)).collect()}
    # 1 leads to a blocked url; 2 and 3 meet 4, which is blocked, in a url that is no page
    assert got[1] == got[2] == got[3] == (None, "block") and got[4] == ("com/de/", "block")
    # an allowed url that is no page comes before a blocked one
    assert got[5] == got[6] == got[7] == got[8] == (None, "allow")
    cut = {r["page_id"]: r["verdict"] for r in ur.judge(pages, rules, ur.alias_edges(pages.where("page_id IN (6, 7)"))).collect()}
    assert cut[5] == cut[6] == cut[7] == "block" and cut[1] == "allow"


def test_forms_of_edges(spark, rows):
    url = "https://h.net/a/b?q"
    forms = [
        ('<link rel="canonical" href="/c">', ["https://h.net/c"]), ("<link rel='canonical' href='//k.org/d?x#f'>", ["https://k.org/d?x#f"]),
        ('<meta http-equiv="refresh" content="0; url=next.html">', ["https://h.net/a/next.html"]), ("<META content=5;URL=../up/./x/.. HTTP-EQUIV=Refresh>", ["https://h.net/up/"]),
        ("<link href=http://u.org/1 rel=canonical>", ["http://u.org/1"]), ('<link rel="alternate canonical" href="?z">', ["https://h.net/a/b?z"]),
        ('<link rel=canonical href="http://one.org/"><link title="a > b" rel=CANONICAL href=http://two.org/ ><meta http-equiv=refresh content="1, \'http://three.org/\'">', ["http://one.org/", "http://three.org/", "http://two.org/"]),
        ('<link rel=stylesheet href="/s"><link rel="canonical"><link rel=canonical href="#f"><link rel=canonical href="mailto:x@y"><meta http-equiv=refresh content=30>', []),
        ('<link rel="xcanonical" href="/n" title="rel=canonical"><meta name=refresh content="0;url=/n">', []), (None, []), ("", []),
    ]
    pages = rows([(f"{url}{i}", h) for i, (h, _) in enumerate(forms)], "url string, html string")
    got = {}
    for u, alias in ur.alias_edges(pages).collect():
        got.setdefault(u, []).append(alias)
    assert {i: sorted(got.get(f"{url}{i}", [])) for i in range(len(forms))} == {i: want for i, (_, want) in enumerate(forms)}
    pages = rows([(1, "http://p.net/x", '<link rel=canonical href="//shop.com/de/1">'), (2, "http://shop.com/q", "<meta http-equiv=refresh content='0;url=de/2'>"), (3, "nothing", '<link rel=canonical href="/a">')], "page_id long, url string, html string")
    rules = spark.createDataFrame(ur.RULES, "host string, path string, verdict string")
    assert {r["page_id"]: r["verdict"] for r in ur.judge(pages, rules, ur.alias_edges(pages)).collect()} == {1: "block", 2: "block", 3: "allow"}


def brute_verdicts(pages):
    """The same from Python's own HTML parser and url functions, pairs by pairs."""
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.targets = []

        def handle_starttag(self, tag, attrs):
            a = dict(reversed(attrs))
            if tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
                self.targets.append(a.get("href") or "")
            if tag == "meta" and (a.get("http-equiv") or "").lower() == "refresh" and "url=" in (a.get("content") or ""):
                self.targets.append(a["content"].split("url=", 1)[1])

    def cut(url):
        rest = (url or "").split("://", 1)
        if len(rest) < 2:
            return "", "", None
        host = rest[1].split("/")[0].split("?")[0].split("#")[0]
        tail = rest[1][len(host):].split("#")[0]
        return host.lower(), tail.split("?")[0], host.lower() + tail

    def ruled(host, path):
        fits = [(len(h) + len(p), h + p, v) for h, p, v in ur.RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    ends = set()
    for _, url, html in pages:
        links = Links()
        links.feed(html or "")
        for t in links.targets:
            u, v = cut(url)[2], cut(urljoin(url, t) if url and t and not t.startswith("#") else None)[2]
            if u is not None and v is not None:
                ends |= {u, v}
                root[find(u)] = find(v)
    spread = {}
    for x in ends:
        v = ruled(*cut("x://" + x)[:2])[1]
        if v:
            spread.setdefault(find(x), set()).add(v)
    out = []
    for page_id, url, _ in pages:
        host, path, resource = cut(url)
        rule, verdict = ruled(host, path)
        votes = spread.get(find(resource), set()) if resource in ends else set()
        out.append((page_id, host, path, rule, verdict or ("allow" if "allow" in votes else "block" if "block" in votes else "allow")))
    return sorted(out)


def test_edges_and_verdicts_equal_brute_force(spark, rows):
    import random

    r = random.Random(12)
    hosts = ["shop.com", "A.example.org", "example.org", "n.net", "m.net", "k.com", "x.io", "y.io", "z.io"]
    paths = ["/", "/de/1", "/fr/2", "/es/3", "/en/12", "/p/q", "/p/r?a=1&b=2", "", "/p/"]
    any_url = lambda: r.choice(["http", "https"]) + "://" + r.choice(hosts) + r.choice(paths) + r.choice(["", "", "#f"])

    def target():
        return r.choice([any_url, any_url, lambda: r.choice(paths), lambda: "//" + r.choice(hosts) + r.choice(paths), lambda: r.choice(["next", "../up", "./x", "?z=1", "#f", ""])])()

    def edge():
        t = target().replace("&", r.choice(["&amp;", "&"]))
        return r.choice([
            f'<link rel="canonical" href="{t}">', f"<LINK href='{t}' REL='x Canonical'/>", f'<meta http-equiv="refresh" content="0; url={t}">', f'<meta content="5;url={t}" http-equiv=Refresh>',
            f'<link rel="next" href="{t}">', f'<a rel="canonical" href="{t}">x</a>', f'<meta name="refresh" content="0; url={t}">'])

    pages = [(i, r.choice([any_url(), any_url(), any_url(), None, "no scheme"]) if i % 9 == 0 else any_url(), "<p>t</p>" + "".join(edge() for _ in range(r.choice([0, 0, 0, 1, 1, 2])))) for i in range(400)]
    frame = rows(pages, "page_id long, url string, html string")
    got = ur.judge(frame, spark.createDataFrame(ur.RULES, "host string, path string, verdict string"), ur.alias_edges(frame))
    assert sorted(map(tuple, got.collect())) == brute_verdicts(pages)
    # few hosts make few components; with hosts of their own many stay apart
    pages = [(i, (u or "x").replace("://", f"://h{i % 60}."), h.replace("://", f"://h{(i + 1) % 60}.")) for i, u, h in pages]
    frame = rows(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, ur.judge(frame, spark.createDataFrame(ur.RULES, "host string, path string, verdict string"), ur.alias_edges(frame)).collect()))
    assert got == brute_verdicts(pages) and len({g[3:] for g in got}) > 6
