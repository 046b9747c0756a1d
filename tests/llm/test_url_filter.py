import itertools
import math
import re
from collections import Counter

import pytest

from pairloom.llm import common
from pairloom.llm.queries import URL_RULES
from pairloom.llm.url_filter import best_split, judged_urls, segmented


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_judge(rows):
    """{page_id: (host, path, rule, verdict)} by naive Bayes over all splits tried one by one."""
    counts = Counter(w for _, _, html in rows for w in re.split(r"[\W\d_]+", re.sub(r"<[^>]*>", " ", html or "").lower()) if w)
    total = sum(counts.values()) or 2

    def cost(words):
        return sum(math.log(counts[w] / total) if w in counts else -math.log(total) - len(w) * math.log(10) for w in words)

    def split(name):
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), k) for k in range(len(name)))
        options = [[name[i:j] for i, j in zip((0, *c), (*c, len(name)))] for c in cuts]
        # Unknown runs aren't cut in the search either way of cost: each pays the start anew.
        return max(options, key=cost)

    def tokens(url):
        host, path = plain_parts(url)
        out = [w for name in re.split(r"[\W_]+", host) if name for w in split(name)]
        for run in re.split(r"[\W_]+", path.lower()):
            if run:
                out.append(f"/#{len(run)}" if re.fullmatch("[0-9]+", run) else "/" + run)
        return out

    seen = {"allow": Counter(), "block": Counter()}
    prior = Counter()
    vocabulary = set()
    for _, url, _ in rows:
        verdict = plain_rule(*plain_parts(url))[1]
        vocabulary |= set(tokens(url))
        if verdict:
            prior[verdict] += 1
            seen[verdict].update(tokens(url))
    out = {}
    for page, url, _ in rows:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        score = math.log(prior["block"] / prior["allow"])
        for t in tokens(url):
            score += math.log((seen["block"][t] + 1) / (seen["block"].total() + len(vocabulary)))
            score -= math.log((seen["allow"][t] + 1) / (seen["allow"].total() + len(vocabulary)))
        out[page] = (host, path, rule, verdict or ("block" if score > 0 else "allow"), score)
    return out


def test_equals_brute_force_on_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = plain_judge([(r.page_id, r.url, r.html) for r in pages.collect()])
    for r in judged_urls(pages, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id][:4]
        assert r.score == pytest.approx(want[r.page_id][4])


def test_odd_urls(spark):
    urls = [None, "", "nothing", "HTTP://A.ORG", "http://x.example.ORG/en/1?q", "http://notexample.org/en/1", "http://example.org/es/a#b", "a://b.com/de/x://c", "http://com/fr/", "http://[::1]:80/a?b", "http://é.net/ß/1", "//x.com/de/", "http://b.com/DE/"]
    rows = [(i, u, "<p>Hello hello</p>", "r", "v") for i, u in enumerate([*urls, *urls[4:6]])]
    pages = spark.createDataFrame([*rows, (None, None, None, None, None)], "page_id long, url string, html string, rule string, verdict string")
    got = judged_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows) + 1
    by_id = {r.page_id: r for r in got}
    for i, u, *_ in rows:
        host, path = plain_parts(u)
        assert (by_id[i].host, by_id[i].path) == (host, path)
        assert (by_id[i].rule, by_id[i].verdict) == plain_rule(host, path) or by_id[i].rule is None and by_id[i].verdict in ("allow", "block")
    assert by_id[4].rule == "example.org/en/1" and by_id[6].verdict == "block" and by_id[8].rule == "com/fr/"
    assert judged_urls(pages.where("false"), URL_RULES).count() == 0
    only = judged_urls(pages.where("page_id in (2, 3, 9)"), [("block", "none", "/")]).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_split():
    assert best_split("thecatxq", [(0, 3, 50), (3, 3, 20), (0, 2, 1), (1, 2, 1)], 100) == ["the", "cat", "xq"]
    assert best_split("", [], 10) == []


def test_words_of_any_length_are_known(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    urls = [f"http://x{long}shop.org/a", "http://shop.com/de/b", f"http://{long}.net/c", "http://" + "ab" * 2000 + ".net/" + "d" * 50_000]
    html = f"<p>{long} shop shop x</p>"
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in judged_urls(pages, URL_RULES).collect()}
    assert len(got) == 4 and len(got[3].path) == 50_001
    names = spark.createDataFrame([(f"x{long}shop",), ("q",)], "name string")
    words = spark.createDataFrame([(long, 1), ("shop", 2), ("x", 1)], "word string, n long")
    assert {r.name: r.words for r in segmented(names, words).collect()} == {f"x{long}shop": ["x", long, "shop"], "q": ["q"]}


def test_hot_urls_hosts_and_words_are_dealt_over_tasks(spark, monkeypatch):
    urls = [None, "http://hot.example.net/a", "http://a.b.org/x", "http://example.com/de/y", *[f"http://hot.example.net/p{i}" for i in range(60)]]
    rows = [(i, urls[i % 3] if i % 2 else urls[i // 2 % len(urls)], "<p>hot example words here</p>") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("allow", "org", "/"), ("block", "com", "/de/")]
    plain = sorted(map(tuple, judged_urls(pages, rules).collect()), key=lambda r: r[0])
    monkeypatch.setattr(common, "ROWS_TOGETHER", 20)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    dealt = sorted(map(tuple, judged_urls(pages, rules).collect()), key=lambda r: r[0])
    assert len(dealt) == 900 and [r[:5] for r in dealt] == [r[:5] for r in plain]
    assert all(abs(a[5] - b[5]) < 1e-9 for a, b in zip(dealt, plain))
