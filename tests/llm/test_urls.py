from psephos.llm import urls
from psephos.llm.queries import URL_RULES


def pages(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", 1, None) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string, rule int, verdict string")
    return df


def judged(spark, rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages(spark, rows), URL_RULES).collect()}


def test_rules(spark):
    rows = [
        ("http://WWW.Example.org/es/1", None), ("http://example.org/en/17?x", ""), ("http://notexample.org/es/", None), ("x://a.com/fr/#f", None),
        ("https://a.com/de", None), ("https://org", None), ("https://u.net/a://b/c", None), (None, None), ("no scheme", None), ("http://org/?q", None), ("http://É.com/de/", None),
    ]
    assert list(judged(spark, rows).values()) == [
        ("www.example.org", "/es/1", "example.org/es/", "block"),
        ("example.org", "/en/17", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("a.com", "/fr/", "com/fr/", "allow"),
        ("a.com", "/de", None, "allow"),
        ("org", "", None, "allow"),
        ("u.net", "/a://b/c", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("org", "/", "org/", "allow"),
        ("É.com", "/de/", "com/de/", "block"),
    ]


def test_propagation_equals_brute_force(spark):
    links = {"http://good.org/a": ["http://x.net/1", "//y.net/"], "http://x.net/": ["http://y.net/2", "/own", "http://bad.com/de/1"], "http://bad.com/de/1": ["http://z.net/"], "http://w.net/": ["HTTP://BAD.com/de/9", "http://bad.com/"], "http://y.net/2": [], "http://z.net/": ["mailto:a@b.c"]}
    rows = [(u, "".join(f"<A class=c href='{x}'>t</a>" for x in to)) for u, to in links.items()]
    host = lambda u: u.lower().split("://" if "://" in u else "//")[1].split("/")[0]
    edges = {}
    for u, to in links.items():
        for x in to:
            if "//" in x and host(x) != host(u):
                edges[host(u), host(x)] = edges.get((host(u), host(x)), 0) + 1
    seeds = {"t": {"good.org": 1.0}, "d": {"bad.com": 1.0}}
    score = {}
    for kind, seed in seeds.items():
        way = edges if kind == "t" else {(b, a): n for (a, b), n in edges.items()}
        s = dict(seed)
        for _ in range(urls.STEPS):
            new = {h: (1 - urls.DAMPING) * x for h, x in seed.items()}
            for (a, b), n in way.items():
                if a in s:
                    new[b] = new.get(b, 0) + urls.DAMPING * s[a] * n / sum(m for (c, _), m in way.items() if c == a)
            s = new
        score[kind] = s
    got = urls.propagate(urls.host_edges(pages(spark, rows)), spark.createDataFrame([("good.org", 1.0, 0.0), ("bad.com", 0.0, 1.0)], "host string, trust double, distrust double"))
    for r in got.collect():
        assert abs(r.trust - score["t"].get(r.host, 0)) < 1e-9 and abs(r.distrust - score["d"].get(r.host, 0)) < 1e-9
    verdicts = {u: v[3] for u, v in zip(links, judged(spark, rows).values(), strict=True)}
    assert verdicts["http://w.net/"] == "block" and verdicts["http://y.net/2"] == "allow" and verdicts["http://good.org/a"] == "allow"


def test_distance_and_dilution_change_no_verdict(spark):
    """Hosts 20 links before a blocked one, and hosts with a small part of a blocked one's links, are blocked."""
    rows = [("http://bad.com/de/1", ""), ("http://far0.net/", "<a href=http://bad.com/de/1>x</a>")]
    rows += [(f"http://far{i + 1}.net/", f"<a href=http://far{i}.net/>x</a>") for i in range(19)]
    near = ["bad.com", *(f"small{i}.net" for i in range(4))]
    for i in range(4):
        rows += [(f"http://{near[i + 1]}/", f"<a href=http://{near[i]}/>x</a>"), (f"http://large{i}.net/", f"<a href=http://{near[i]}/>x</a>" * 2000)]
    rows += [("http://loop1.net/", "<a href=http://loop2.net/>x</a>"), ("http://loop2.net/", "<a href=http://loop1.net/>x</a><a href=http://bad.com/>x</a>"), ("http://other.net/", "")]
    got = {h: v for h, _, _, v in judged(spark, rows).values()}
    assert got.pop("other.net") == "allow"
    assert set(got.values()) == {"block"}


def test_repeated_rows_and_empty(spark):
    rows = [("http://a.org/x", "<a href=http://b.net/>b</a>")] * 3
    assert len(judged(spark, rows)) == 3
    assert urls.judge_urls(pages(spark, rows).limit(0), URL_RULES).count() == 0
