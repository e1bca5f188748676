import itertools
import random
import re

from frostline.llm import urls

CASES = [
    ("https://www.example.com/en/1.html?x=1#y", "www.example.com/en/", "allow"), ("http://a.Example.COM/en/2", "example.com/en/", "block"),
    ("http://example.com/de/", "com/", "allow"), ("http://example.com", "com/", None), ("x://notexample.com/en/", "com/", "allow"),
    ("http://a.net/es/q", "net/es/", "block"), ("http://a.net/es", None, None), ("http://net/fr/", "net/fr/", "block"), ("ftp://a.org/fr/", None, None),
    (None, None, None), ("", None, None), ("no scheme", None, None), ("http://a.net?/es/", None, None), ("http://b.com#/en/", "com/", None),
    ("a://b://c.com/x", None, None), ("://x.net/fr/\nz", "net/fr/", "block"),
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def listed(host, path):
    best = None
    for says, text in urls.RULES:
        domain, start = text.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(text) > len(best[1])):
            best = says, text
    return best


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, (u, _, _) in enumerate(CASES)], "page_id long, url string, host string, tokens string")
    rows = {r.page_id: r for r in urls.judge(df).collect()}
    assert len(rows) == len(CASES)
    for i, (url, rule, _) in enumerate(CASES):
        host, path = split(url)
        want = listed(host, path)
        r = rows[i]
        assert (r.host, r.path) == (host, path), url
        assert r.rule == (want[1] if want else None), url
        assert r.verdict == want[0] if want else r.verdict in ("allow", "block"), url


def test_mined_rules_judge_what_no_list_does(spark):
    rows = [(i, f"http://shop{i % 7}.example.com/en/{i}.html") for i in range(60)] + [(100 + i, f"http://www.other{i}.com/de/{i}/") for i in range(60)]
    rows += [(300, "http://x.example.org/en/9.html"), (301, "http://www.thing.org/de/1/"), (302, None), (302, None)]
    got = [(r.page_id, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert len(got) == len(rows)
    assert (300, None, "block") in got and (301, None, "allow") in got and got.count((302, None, "allow")) == 2


def test_a_rule_fits_only_with_all_its_tokens(spark):
    rules = spark.createDataFrame([(1, ["a", "b"], "block", 0.9), (2, ["c"], "allow", 0.95), (3, ["a", "c"], "block", 0.95)], "rule_id long, tokens array<string>, verdict string, confidence double")
    pages = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "x"]), (3, ["c", "a"]), (4, ["c"]), (5, [])], "page_id long, tokens array<string>")
    assert {tuple(r) for r in urls.match(pages, rules, "page_id").collect()} == {(2, "block"), (3, "block"), (4, "allow")}


def test_nothing(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def plain_tokens(host, path):
    fold = lambda x: re.sub("[0-9]+", "#", x.lower())
    words = list(dict.fromkeys(w for label in host.split(".")[:-2] for w in fold(label).split("-") if w))[-urls.WORDS:]
    folders = [f for f in path.split("/")[:-1] if f]
    chosen = folders[:2] + (folders[-1:] if len(folders) > 2 else [])
    ending = re.search(r"\.([A-Za-z0-9]{1,8})\Z", path)
    return set(["ending=" + fold(ending[1])] if ending else []) | {"word=" + w for w in words} | {"folder=" + fold(f) for f in chosen}


def plain_rules(labelled, support, confidence, lift, least):
    """All token sets counted one by one."""
    seen, says = {}, {}
    for tokens, verdict in labelled:
        says[verdict] = says.get(verdict, 0) + 1
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                seen.setdefault(part, []).append(verdict)
    n, out = len(labelled), {}
    for part, verdicts in seen.items():
        for v, total in says.items():
            hits = verdicts.count(v)
            sure = hits / len(verdicts)
            if hits >= max(support * n, least) and sure >= confidence and sure / (total / n) >= lift:
                out[part, v] = sure, hits / n
    return {
        (part, v): x for (part, v), x in out.items()
        if not any(w == v and set(p) < set(part) and y[0] >= x[0] for (p, w), y in out.items())
    }


def _fixture():
    r = random.Random(3)
    rows = [f"http://{r.choice(['www.', 'shop.', 'm.a-b.', 'b1.', ''])}{r.choice(['example.com', 'example.net', 'example.org', 'x.com'])}"
            f"/{r.choice(['en', 'de', 'fr', 'es', 'en/news', 'de/a/b/c3'])}/{r.randrange(50)}{r.choice(['', '.html', '/'])}" for _ in range(900)]
    rows += ["http://" + "a-" * 3_000 + "z.example.com/en/" + "d/" * 3_000 + "x.html", "http://.//", "http://a..b--c.example.org//en///1", None, ""]
    return list(enumerate(rows))


def test_mining_equals_counting_all_token_sets(spark):
    rows = _fixture()
    plain, labelled = {}, []
    for i, url in rows:
        host, path = split(url)
        plain[i] = plain_tokens(host, path), listed(host, path)
        if plain[i][1]:
            labelled.append((plain[i][0], plain[i][1][0]))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    seen = urls.described(pages)
    assert {r.page_id: set(r.tokens) for r in seen.collect()} == {i: t for i, (t, _) in plain.items()}
    want = plain_rules(labelled, 0.002, 0.8, 1.2, 20)
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in urls.mine(urls.labels(seen)).collect()}
    assert got.keys() == want.keys() and len(want) > 3
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    judged = urls.judge(pages).collect()
    assert sorted(judged) == sorted(urls.judge(pages, common=4).collect()) and len(judged) == len(rows)
    for r in judged:
        tokens, rule = plain[r.page_id]
        fits = [(round(c, 9), len(p), v == "block", v) for (p, v), (c, _) in want.items() if set(p) <= tokens]
        best = max(fits)[:3] if fits else None
        assert r.mined == (rule is None and bool(fits))
        assert r.verdict == (rule[0] if rule else {f[3] for f in fits if f[:3] == best}.pop() if fits else "allow")


def test_a_single_page_is_no_evidence(spark):
    rows = [(i, f"http://www.example.com/de/{i}") for i in range(30)] + [(50, "http://odd.example.net/es/1"), (51, "http://odd.example.org/it/1")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[50].verdict == "block" and (got[51].verdict, got[51].mined) == ("allow", False)


def test_held_out_listed_pages_agree_with_mined_rules(spark):
    got = urls.agreement(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).first()
    assert got.pages > 10 and got.decided >= got.pages / 3 and got.agree >= 0.75 * got.decided
