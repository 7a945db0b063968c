"""URL rules against plain Python, propagation against a dense matrix."""

from collections import Counter

import numpy as np
import pytest

from terrapanel.llm import url_filter as U

RULES = [U.Rule("allow", "com/"), U.Rule("block", "example.com/en/"), U.Rule("allow", "www.example.com/en/"), U.Rule("block", "net/es/"), U.Rule("block", "net/fr/")]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [k for k, c in enumerate(rest) if c in "/?#"] or [len(rest)]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:ends[0]])
    path = rest[ends[0]:]
    stop = min([k for k, c in enumerate(path) if c in "?#"] or [len(path)])
    return host, path[:stop]


def rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules_equal_python(spark):
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "com", "net", "a.net", "É.net", "a.org", "", "user@a.com:80"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?a=/es/", "/es/#x", "?q=/en/", "/a://b/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "x://", "a\n://b.com/\nen/", "http://a.com/x://b.net/es/"]
    df = spark.createDataFrame([(k, u, None, "r", 1.0) for k, u in enumerate(urls)], "page_id long, url string, html string, rule string, trust double")
    for r in U.judge(df, RULES).collect():
        host, path = parts(urls[r.page_id])
        want = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, want and want.text)
        assert want is None or r.verdict == want.verdict


@pytest.fixture
def web(spark):
    """Hosts g* link to the allowed site, b* are linked from and link to the blocked one."""
    link = lambda *to: "".join(f'<a class=x HREF = "http://{t}/p">t</a><a href="/own">o</a>' for t in to)
    rows = [("http://good.com/1", link("a.org", "B.org", "b.org")), ("http://a.org/", link("b.org")), ("http://b.org/", link("c.org", "a.org")), ("http://c.org/", None),
            ("http://bad.net/es/1", link("d.org")), ("http://spam.org/", link("bad.net", "a.org")), ("http://farm.org/", link("spam.org", "bad.net", "farm.org")),
            ("http://d.org/", ""), ("http://alone.org/", "<p>"), (None, link("a.org")), ("http://mixed.net/es/", ""), ("http://mixed.net/en/", ""), ("http://mixed.net/en/2", "")]
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def dense(edges, seeds, damping=0.5, rounds=300):
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    for (a, b), n in edges.items():
        m[at[b], at[a]] += n / out[a]
    s = np.zeros(len(hosts))
    for h in seeds:
        s[at[h]] = 1
    r, wave = np.zeros(len(hosts)), s
    for _ in range(rounds):
        r, wave = r + wave, damping * m @ wave
    return {h: (1 - damping) * r[at[h]] for h in hosts}


def test_propagation_equals_dense_matrix(web):
    edges = {("good.com", "a.org"): 1, ("good.com", "b.org"): 2, ("a.org", "b.org"): 1, ("b.org", "c.org"): 1, ("b.org", "a.org"): 1, ("bad.net", "d.org"): 1,
             ("spam.org", "bad.net"): 1, ("spam.org", "a.org"): 1, ("farm.org", "spam.org"): 1, ("farm.org", "bad.net"): 1}
    trust = dense(edges, ["good.com"])
    distrust = dense({(b, a): n for (a, b), n in edges.items()}, ["bad.net"])
    got = {r.host: r for r in U.judge(web, RULES, damping=0.5, tolerance=1e-5).collect()}
    for host in ("good.com", "a.org", "b.org", "c.org", "bad.net", "spam.org", "farm.org", "d.org"):
        assert got[host].trust == pytest.approx(trust.get(host, 0), abs=1e-4) and got[host].distrust == pytest.approx(distrust.get(host, 0), abs=1e-4)
    verdict = {h: r.verdict for h, r in got.items()}
    assert verdict["spam.org"] == verdict["farm.org"] == "block"
    assert all(verdict[h] == "allow" for h in ("a.org", "b.org", "c.org", "d.org", "alone.org", "", "mixed.net"))


def test_a_section_does_not_damn_its_host(web):
    got = [(r.path, r.verdict) for r in U.judge(web, RULES, damping=0.5, tolerance=1e-2).collect() if r.host == "mixed.net"]
    assert sorted(got) == [("/en/", "allow"), ("/en/2", "allow"), ("/es/", "block")]


def test_repeated_pages_and_empty_table(web):
    assert U.judge(web.unionByName(web), RULES, damping=0.5, tolerance=1e-2).count() == 2 * web.count()
    assert U.judge(web.filter("1 = 0"), RULES).count() == 0 and U.judge(web, [], damping=0.5).filter("verdict = 'block'").count() == 0


def test_unlinked_seeds_do_not_hide_a_blocked_neighbour(spark):
    rows = [(f"http://s{k}.com/", "") for k in range(10_000)] + [("http://bad.net/es/", ""), ("http://near.org/", '<a href="http://bad.net/es/">')]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    near = U.judge(pages, RULES).filter("host = 'near.org'").first()
    assert near.distrust == pytest.approx(0.1275) and near.verdict == "block"


def test_tolerance_holds_for_each_host_however_large_the_mass(spark):
    """Many seeds of one host that links in a circle: the rest that is left out is small in itself, not beside the seeds."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("hub", "a", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("hub", "trust", 1e4), ("b", "distrust", 1.0)], "host string, kind string, mass double")
    got = {r.host: r for r in U.propagate(edges, seeds, damping=0.5, tolerance=1e-2).collect()}
    assert got["a"].trust == pytest.approx(1e4 * 0.5 * 0.5 / (1 - 0.25), abs=1e-2)
    assert got["b"].trust == pytest.approx(1e4 * 0.5 * 0.25 / (1 - 0.25), abs=1e-2)
