import fnmatch
import random
import re

import pytest

from shardsort.llm import url_filter

URLS = "page_id long, url string, host string, path string, rule int, verdict string"


def plain_host(url):
    if not url or "://" not in url:
        return ""
    host = re.split("[/?#]", url.split("://", 1)[1])[0].split("@")[-1].translate(url_filter._UPPER)
    return re.sub(r"(?:(?<=^http)|):80$|:443$|:$", "", host)


def plain_path(url):
    if not url or "://" not in url:
        return ""
    rest = url.split("://", 1)[1].split("#")[0]
    return re.sub(r"^[^/?]*", "", rest).replace("%73", "s").lower()


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for mark in "?#":
            rest = rest.split(mark)[0]
        host = rest.split("/")[0]
        path = rest[len(host) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.name), r.name), default=None)
    blocked = bool(re.search(rf"(?:^|[.-])(?:{'|'.join(url_filter.BLOCKED_WORDS)})(?:[.-]|$)", plain_host(url))) or any(p.strip("*") in plain_path(url) for p in url_filter.BLOCKED_PATHS)
    return host, path, best.name if best else None, best.verdict if best else "block" if blocked else "allow"


def test_random_urls(spark):
    rng = random.Random(1)
    hosts = ["com", "example.com", "www.example.com", "WWW.Example.COM", "a.b.net", "net", "xnet", "notexample.com", "spam-x.org", "x.org", "", "é.net", "com.evil.org", ".com", "cheap-pills.org", "u@pills.org:80", "spills.org", "antispam.org", "alphabets.org", "my-bets"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/x?y", "#a/en/", "?q=/en/", "/x/com/en/", "/EN/", "/en/ ü*", "://", "/a/Casino/b", "/casinos/", "/%73pam/x", "?x=/porn/y"]
    urls = [rng.choice(["http://", "https://", "", "a://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(1500)] * 2 + [None, "", "x" * 5000, "http://" + "a." * 4000 + "net/es/"]
    rows = [(k, u, "c", "c", 1, "c") for k, u in enumerate(urls)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(spark.createDataFrame(rows, URLS)).collect()}
    assert got == {k: brute(u, url_filter.BASE_RULES) for k, u in enumerate(urls)}


def test_globs_like_fnmatch():
    rng = random.Random(2)
    word = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))
    for _ in range(150):
        patterns = [(word("ab*", 6), word("/c*", 6)) for _ in range(rng.randrange(1, 40))]
        automaton = url_filter.GlobAutomaton(patterns)
        for _ in range(30):
            host, path = word("ab", 7), word("/c", 7)
            assert automaton.matches(host, path) == [k for k, (h, p) in enumerate(patterns) if fnmatch.fnmatchcase(host, h) and fnmatch.fnmatchcase(path, p)]


def test_a_star_in_the_host_stays_there():
    assert url_filter.GlobAutomaton([("*.com", "/*")]).matches("evil.org", "/x.com/") == []


def test_many_rules_span_machine_words():
    automaton = url_filter.GlobAutomaton([(f"host{k}.example", "/*") for k in range(500)])
    assert automaton.matches("host321.example", "/a") == [321] and automaton.matches("host321.example", "") == []


def test_empty(spark):
    assert url_filter.url_verdicts(spark.createDataFrame([], URLS)).count() == 0


def test_a_star_may_be_meant():
    automaton = url_filter.GlobAutomaton([("a\\*b", "/*"), ("a*b", "/\\\\*")])
    assert automaton.matches("a*b", "/x") == [0] and automaton.matches("axb", "/\\y") == [1] and automaton.matches("axb", "/y") == []
    assert url_filter.GlobAutomaton([(url_filter.literal("*\\"), "*")]).matches("*\\", "") == [0]
    with pytest.raises(ValueError):
        url_filter.GlobAutomaton([("a\\", "*")])


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://User@Ex.COM:80/a/./b/../%7Ec%2f?Q=%41#f", (".ex.com.", "/a/~c%2f?q=a")), ("https://x.org:443", (".x.org.", "/")), ("https://x.org:8080/..", (".x.org:8080.", "/")),
        ("http://x.org./a/b/..", (".x.org.", "/a/")), ("x", (".", "")), (None, (".", "")), ("a://b?c", (".b.", "/?c")), ("http://x:443/", (".x:443.", "/")),
    ],
)
def test_canonical(url, want):
    assert url_filter.canonical(url) == want


def test_the_method_blocks_pages_of_the_tables(spark):
    from shardsort.llm.common import table

    got = url_filter.url_verdicts(table(spark, "/root/testdata/sf0.1", "pages").select("url")).filter("rule is null and verdict = 'block'")
    assert {r["host"] for r in got.select("host").distinct().collect()} == {"blog.adult-x.example.net"}
    for host in ("alphabets.org", "spills.org", "antispam.org", "essex.org"):
        assert url_filter.UrlJudge((), url_filter.BLOCKED).judge(f"http://{host}/")[3] == "allow"


def test_rules_of_ones_own(spark):
    rules = (url_filter.Rule("a*.org/", "block", "a*.org", "/"),)
    df = spark.createDataFrame([("http://a*.org/x",), ("http://ab.org/x",), ("http://c.org/shop/p.php?x",)], "url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.url_verdicts(df, rules=rules, blocked=[("*.c.*", "/shop/*.php*")]).collect()]
    assert got == [("a*.org/", "block"), (None, "allow"), (None, "block")]
