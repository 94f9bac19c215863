import random
import re

from pyspark.sql import functions as F

from castplan.llm import url_temporal as U

CHANGES = "list_name string, pattern string, action string, day long"


def active(changes, key, day):
    """(list, since) of the lists on which ``key`` stands on ``day``, change by change."""
    out = []
    for name in {c[0] for c in changes if None not in c}:
        since = None
        own = sorted((c[3], c[2]) for c in changes if None not in c and c[0] == name and c[1].lower() == key and c[2] != "odd")
        last = {}
        for d, a in own:
            last[d] = a  # on one day 'remove' sorts last
        for d in sorted(last):
            if d <= day:
                since = None if last[d] == "remove" else (since if since is not None else d)
        if since is not None:
            out.append((name != "allow", name, since))
    return sorted(out)


def covering(url):
    """The patterns that cover a URL, the most specific first, by plain string work."""
    if url is None:
        return []
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", re.split("[?#]", url)[0]).lower()
    host, slash, path = bare.partition("/")
    host = re.sub(":[0-9]*$", "", host.rpartition("@")[2])
    if not host:
        return []
    path = slash + path
    out = [host + path.rstrip("/")] if path.rstrip("/") else []
    out += [host + path[:i + 1] for i in range(len(path) - 1, 0, -1) if path[i] == "/"]
    labels = host.split(".")
    return [*out, host, *[".".join(labels[i:]) for i in range(1, len(labels) - 1)]]


def test_against_change_by_change_replay(spark):
    rng = random.Random(4)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.org", "p.q.r.s.net"]
    keys = [*hosts, "q.r.s.net", "r.s.net", "s.net", "b.example.com/en/", "b.example.com/en/1", "X.org/page", "x.org/en/2/"]
    changes = [(rng.choice(["allow", "spam", "adult"]), rng.choice(keys), rng.choice(["add", "remove"]), rng.randrange(30)) for _ in range(160)]
    changes += [(None, "x.org", "add", 1), ("spam", None, "add", 1), ("spam", "x.org", "add", None), ("spam", "x.org", "odd", 2)]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/en/1?x=http://z/#t", "/page", "/en/2/3", "/en/2/")] + ["HTTPS://User@X.org:8080/page/", "", None, "nonsense"]
    captures = [(i, rng.choice(urls), rng.choice([*range(32), None])) for i in range(300)]
    out = U.filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_on long"), spark.createDataFrame(changes, CHANGES)).collect()
    assert len(out) == 300 and {r.verdict for r in out} == {"none", "allow", "block"}
    for r in out:
        found = []
        for key in covering(r.url) if r.fetched_on is not None else []:
            found.append((key, active(changes, key, r.fetched_on)))
        best = next(((k, a[0]) for k, a in found if a), None)
        want = ("none", None, None, None) if best is None else ("block" if best[1][0] else "allow", best[1][1], best[0], best[1][2])
        assert (r.verdict, r.matched_list, r.matched_pattern, r.valid_from) == want
        assert r.n_active == sum(len(a) for _, a in found)


def test_url_keys(spark):
    urls = ["HTTPS://u@A.b.Example.com:80/En/x/?q#f", "http://x.org", "", None, "a.c.example.co.uk/a/b/c.html", "http://h/", "e.com//x//", "localhost:80/p"]
    got = [r[0] or [] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(U.url_keys(F.col("url"))).collect()]
    assert got == [covering(u) for u in urls]
    assert got[4] == ["a.c.example.co.uk/a/b/c.html", "a.c.example.co.uk/a/b/", "a.c.example.co.uk/a/", "a.c.example.co.uk", "c.example.co.uk", "example.co.uk", "co.uk"]
    few = spark.createDataFrame([("a.b.c.d.e/1/2/3/4",)], "url string").select(U.url_keys(F.col("url"), 3, 2)).first()[0]
    assert few == ["a.b.c.d.e/1/2/3/4", "a.b.c.d.e/1/", "a.b.c.d.e", "c.d.e", "d.e"]


def test_parents_and_deep_folders_are_found(spark):
    changes = spark.createDataFrame([("spam", "c.example.co.uk", "add", 0), ("adult", "e.com/a/b/", "add", 0), ("allow", "e.com/a/", "add", 0)], CHANGES)
    captures = spark.createDataFrame([(1, "http://a.c.example.co.uk/x", 1), (2, "http://e.com/a/b/c", 1), (3, "http://e.com/a/c", 1), (4, "http://example.co.uk", 1)],
                                     "page_id long, url string, fetched_on long")
    got = {r.page_id: (r.verdict, r.matched_pattern) for r in U.filter_urls(captures, changes).collect()}
    assert got == {1: ("block", "c.example.co.uk"), 2: ("block", "e.com/a/b/"), 3: ("allow", "e.com/a/"), 4: ("none", None)}


def test_hot_urls_and_long_urls(spark):
    long = "http://deep.org/" + "d/" * 20_000 + "x"
    rows = [(i, "http://hot.com/p" if i % 3 else f"http://s{i % 700}.hot.com/p{i}", i % 5) for i in range(6000)] + [(-1, long, 1)]
    changes = spark.createDataFrame([("spam", "hot.com", "add", 2), ("allow", "hot.com/p", "add", 3), ("spam", "deep.org/d/d/", "add", 0)], CHANGES)
    out = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, fetched_on long"), changes).collect()
    want = {i: "none" if d < 2 else "allow" if i % 3 and d > 2 else "block" for i, _, d in rows if i >= 0}
    assert len(out) == 6001 and {r.page_id: r.verdict for r in out if r.page_id >= 0} == want
    assert [(r.verdict, r.matched_pattern) for r in out if r.page_id == -1] == [("block", "deep.org/d/d/")]


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], CHANGES)
    captures = spark.createDataFrame([(1, "http://x.org/a", 3, "h"), (1, "http://x.org/a", 3, "h"), (None, None, None, None)], "page_id long, url string, fetched_on long, VERDICT string")
    out = U.filter_urls(captures, none)
    assert [r.verdict for r in out.collect()] == ["none"] * 3 and out.columns.count("verdict") == 1
    assert U.filter_urls(captures.limit(0), none).count() == 0
