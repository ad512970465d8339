import itertools
import random
from collections import Counter

from cohortlens.llm import urls

SHAPE = "page_id long, url string, verdict string, host string"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest.split("?")[0].split("#")[0] if rest[:1] == "/" else ""
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in host), path


def listed(url):
    host, path = split(url)
    fits = [
        r for r in urls.LISTED
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def pages(spark):
    rng = random.Random(6)
    found = [
        f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.', 'WWW.'])}{rng.choice(['example', 'spam'])}.{rng.choice(['com', 'net', 'org'])}"
        f"{rng.choice(['', '/', '/en/', '/es/', '/fr/', '/en', '/xx/'])}{rng.randint(0, 9)}{rng.choice(['', '?a=1', '#x', '?u=http://b.com/en/'])}"
        for _ in range(900)
    ]
    found += [None, "", "no scheme", "://", "x://", "http://com/", "http://acom/", "a://b://c.com/en/", "http://É.Com/en/", "http://net?/es/", found[0]]
    return [(i, u, "v", None) for i, u in enumerate(found)]


def test_parts_and_listed_rules(spark):
    rows = pages(spark)
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, SHAPE)).collect()}
    assert len(got) == len(rows)
    for i, url, *_ in rows:
        rule = listed(url)
        assert (got[i]["host"], got[i]["path"]) == split(url)
        assert got[i]["rule"] == (rule.name if rule else None)
        if rule:
            assert got[i]["verdict"] == rule.verdict
        assert got[i]["verdict"] in ("allow", "block")


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        tokens = [t for t in "abcde" if rng.random() < 0.5]
        verdict = "block" if {"a", "b"} <= set(tokens) else "allow" if "c" in tokens and rng.random() < 0.9 else None
        rows.append((tokens, verdict))
    got = {
        (tuple(sorted(r["tokens"])), r["verdict"]): round(r["confidence"], 9)
        for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()
    }
    with_tokens, with_both = Counter(), Counter()
    for tokens, verdict in rows:
        for n in range(1, 6):
            for part in itertools.combinations(sorted(tokens), n):
                with_tokens[part] += 1
                with_both[part, verdict] += 1
    least = max(0.05 * len(rows), urls.LEAST_URLS)
    rules = {
        (part, v): round(n / with_tokens[part], 9)
        for (part, v), n in with_both.items()
        if v and n >= least and n / with_tokens[part] >= 0.8
    }
    want = {
        k: c for k, c in rules.items()
        if not any(v == k[1] and set(p) < set(k[0]) and d >= c for (p, v), d in rules.items())
    }
    assert got == want and (("a", "b"), "block") in want


def test_a_mined_rule_decides_an_unlisted_url(spark):
    rules = (urls.Rule("block", "bad.org", "/a/"),)
    rows = [(i, f"http://bad.org/a/{i}?ref=win", None, None) for i in range(60)]
    rows += [(100 + i, f"http://good.org/b/{i}", None, None) for i in range(60)]
    rows += [(200, "http://other.org/c/1?ref=win", None, None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, SHAPE), rules, 0.01, 0.9).collect()}
    assert (got[200]["rule"], got[200]["verdict"]) == (None, "block")
    assert got[100]["verdict"] == "allow"


def test_without_rows_or_listed_verdicts(spark):
    assert urls.judge(spark.createDataFrame([], SHAPE)).count() == 0
    rows = [(1, "http://a.org/", None, None), (1, "http://a.org/", None, None), (2, None, None, None)]
    got = urls.judge(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"}


def test_unlisted_urls_do_not_count_against_a_rule(spark):
    """Most urls with the token are unlisted; all that are listed are blocked."""
    rules = (urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/"))
    rows = [(i, f"http://bad.org/{i}?ref=win", None, None) for i in range(60)]
    rows += [(100 + i, f"http://good.org/{i}?ref=no", None, None) for i in range(60)]
    rows += [(200 + i, f"http://h{i}.net/x{i}?ref=win", None, None) for i in range(300)]
    rows += [(600 + i, f"http://h{i}.net/x{i}", None, None) for i in range(100)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, SHAPE), rules).collect()}
    assert {(got[i]["verdict"], got[i]["mined_rule"]) for i in range(200, 500)} == {("block", "query:win")}
    assert {got[i]["verdict"] for i in [*range(100, 160), *range(600, 700)]} == {"allow"}


def test_long_urls_that_many_rows_share_end_soon(spark):
    """Their pieces come with both verdicts, so none of them decides; the hosts do."""
    rules = (urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/"))
    path = "/".join(f"piece{i}" for i in range(40))
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{path}", None, None) for i in range(80)]
    rows += [(100, f"http://other.net/{path}", None, None), (101, "http://x.net/?u=1", None, None)]
    rows += [(200 + i, "http://other.net/" + path * 50, None, None) for i in range(30)]
    df = spark.createDataFrame(rows, SHAPE)
    labelled = urls.with_parts(df.where("page_id < 80")).withColumn("verdict", urls.listed_rule(rules)[1])
    labelled = labelled.select(urls.tokens().alias("tokens"), "verdict")
    mined = {(tuple(r["tokens"]), r["verdict"]) for r in urls.mine(labelled, 0.1, 0.8).collect()}
    assert mined == {(("under:bad.org",), "block"), (("under:good.org",), "allow")}
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, rules, 0.1, 0.8).collect()}
    assert len(got) == len(rows) and got[1] == "block" and got[0] == got[100] == got[101] == got[229] == "allow"


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    rules = (urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "good.org", "/"))
    rows = [(i, f"http://{'bad' if i < 45 else 'good'}.org/?aa&zz&n{i % 3}", None, None) for i in range(50)]
    rows += [(100 + i, f"http://good.org/{i}?n{i % 3}", None, None) for i in range(50)]
    rows += [(200, "http://h.net/?zz", None, None), (201, "http://h.net/?n1", None, None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, SHAPE), rules, 0.1, 0.85).collect()}
    assert (got[200]["verdict"], got[200]["mined_rule"]) == ("block", "query:aa")
    assert got[201]["verdict"] == "allow"
