import random
import re

from rostrum.llm import urls

SCHEMA = "page_id long, url string, host string, rule int"


def naive(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (r[0].count("."), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def sample():
    rng = random.Random(12)
    labels, parts = ["com", "net", "example", "www", "É", "a"], ["", "en", "e", "fr", "enx"]
    rules = {}
    for _ in range(60):
        rules[".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    found = [None, "", "no scheme", "http://", "http:///en/", "x://EXAMPLE.com?/en/", "https://a.com#/x", "http://" + "a." * 20_000 + "com/en/"]
    for _ in range(400):
        host = ".".join(rng.choice([*labels, "WWW", ""]) for _ in range(rng.randrange(0, 5)))
        found.append(rng.choice(["http", "ftp"]) + "://" + host + rng.choice(["", "/"]) + "/".join(rng.choice(parts) for _ in range(rng.randrange(0, 4))) + rng.choice(["", "?q=/en/", "#x", "/?://"]))
    return found, rules


def test_trie_and_join_equal_brute_force(spark):
    found, rules = sample()
    df = spark.createDataFrame([(i, u, "old", 0) for i, u in enumerate(found)], SCHEMA)
    want = {i: naive(u, rules) for i, u in enumerate(found)}
    out = urls.judge(df, rules)
    assert sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()} == want
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    joined = urls.judge_by_join(df, table, "page_id")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in joined.collect()} == want


def test_large_tries_are_refused_and_empty_tables_pass(spark):
    import pytest

    df = spark.createDataFrame([], SCHEMA)
    assert urls.judge(df, [("com", "/", "allow")]).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df, [("com", "/", "allow")], max_trie_bytes=10)
