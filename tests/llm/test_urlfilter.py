import random
import subprocess
import sys

from pyspark.sql import functions as F

from tidemark.llm import queries, urlfilter

RULES = queries.URL_RULES
URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://a.example.com/fr/", "http://example.net/es/a", "x://y.example.net/fr/#/es/", "http://com", "http://com/", "http://notexample.com/en/", "http://exampleé.com/en/", "a://b://c.com/en/", "http://example.com:80/en/", "http://www.example.com/en", "http://q?://com/"]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        k = 0
        while k < len(rest) and rest[k] not in "/?#":
            host += chr(ord(rest[k]) + 32) if "A" <= rest[k] <= "Z" else rest[k]
            k += 1
        while k < len(rest) and rest[k] not in "?#":
            path += rest[k]
            k += 1
    fits = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits)[1:] if fits else (None, "allow")
    return host, path, *rule


def test_both_ways_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    rows = pages.unionByName(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    expected = sorted((r["page_id"], *plain(r["url"])) for r in rows.collect())
    key = lambda r: r[0]
    assert sorted((tuple(r) for r in urlfilter.judge(rows, RULES).collect()), key=key) == expected
    table = spark.createDataFrame(RULES, "host string, path string, action string")
    assert sorted((tuple(r) for r in urlfilter.judge_by_join(rows, table).collect()), key=key) == expected
    assert urlfilter.judge(rows, []).where("rule is not null or verdict = 'block'").count() == 0
    assert urlfilter.judge(rows.where("false"), RULES).count() == 0


def index_of(rules, folder):
    return urlfilter.DigestIndex(urlfilter.DigestIndex.write(rules, str(folder))[0].removesuffix("-digests.npy"))


def test_long_hosts_and_paths(spark):
    rules = [("com", "/" + "a" * 300, "block"), ("b." * 60 + "com", "/", "block"), ("com", "", "allow")]
    urls = ["x://" + "b." * 3000 + "com/" + "a" * 20_000, "x://com/" + "a" * 299, "x://" + "b." * 60 + "com/", "x://b.org/", None]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict")})
    want = ["com/" + "a" * 300, "com", "b." * 60 + "com/", None, None]
    for found in (urlfilter.judge(rows, rules), urlfilter.judge_by_join(rows, spark.createDataFrame(rules, "host string, path string, action string"))):
        assert [r["rule"] for r in found.orderBy("page_id").collect()] == want


def test_a_million_rules_take_little_memory(tmp_path):
    rules = [(f"host{k}.example{k % 977}.org", f"/{k % 31}/", "block") for k in range(1_000_000)]
    prefix = urlfilter.DigestIndex.write(rules, str(tmp_path))[0].removesuffix("-digests.npy")
    code = f"""
from tidemark.llm import urlfilter
def own():  # memory that isn't mapped from a file, in MB
    return sum(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon")) / 1024
before = own()
index = urlfilter.DigestIndex({prefix!r})
found = index.decide([(f"a.host{{k}}.example{{k % 977}}.org", f"/{{k % 31}}/x") for k in range(0, 1_000_000, 100)])
assert all(r for r, _ in found), found[:3]
assert own() - before < 200, own() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda key: len(key))
    rng = random.Random(0)
    rules = [("".join(rng.choice("abc") for _ in range(6)), "/", "block") for _ in range(50)]
    index = index_of(rules, tmp_path)
    keys = {h for h, _, _ in rules}
    tried = ["".join(rng.choice("abc") for _ in range(6)) for _ in range(300)] + sorted(keys)
    found = index.find([f"{h}\n/".encode() for h in tried])
    assert [k >= 0 for k in found] == [h in keys for h in tried]
