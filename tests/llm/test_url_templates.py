import re

import numpy as np

from shelfspark.llm import url_templates as u


def brute(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in u.RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(r.split("/")[0], r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_parts_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = u.judge_urls(pages).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    spam = [r for r in rows if r["rule"] is None and re.search("casino|pills|bets|spam", r["host"])]
    assert spam and all(r["verdict"] == "block" for r in spam)


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "http://EXAMPLE.org", "http://example.org/en/1x", "x://a://b/c", "http://a.com/fr/1?x://y", "http://notexample.org/en/1", "http://org/", "http://u@h.com:80/de/2#f", "http://h/\n/a", "http://h" + "/a" * 300, "http://h/a"]
    df = spark.createDataFrame([(i, x, "h", 1, "t") for i, x in enumerate(odd * 2)], "page_id long, url string, host string, label int, template string")
    rows = u.judge_urls(df).collect()
    assert len(rows) == 2 * len(odd)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == brute(odd[r["page_id"] % len(odd)])[:3]
    assert u.judge_urls(df.limit(0)).count() == 0


def test_branches_generalise_merge_and_reject(spark):
    rows = [(i, f"http://h.net/shop/item{i}/x") for i in range(60)] + [(100 + 3 * i + j, f"http://h.net/{p}/{i}") for i in range(40) for j, p in enumerate(("good", "fine", "bad"))]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.selectExpr("page_id", "cast(url like '%/bad/%' as int) bad")
    got = u.judge_urls(pages, labels=labels).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"].split("/")[1], set()).add((r["template"], r["verdict"]))
    assert by["bad"] == {("/bad/...", "block")} and {v for _, v in by["good"] | by["fine"] | by["shop"]} == {"allow"}
    assert len(by["shop"]) == 1


def brute_tree(rows, labels):
    """The verdicts of urls by a tree in plain Python: rows are (id, host, segments), labels id -> 0 or 1."""
    known = {i: labels.get(i) for i, _, _ in rows}
    top, out = sum(v == 1 for v in known.values()) / len(rows), {}

    def rate(ids, prior):
        own = [known[i] for i in ids if known[i] is not None]
        return (sum(own) + u.PRIOR_WEIGHT * prior) / (len(own) + u.PRIOR_WEIGHT), sum(own), len(own)

    def down(members, depth, share, bad, n):
        rest = [m for m in members if len(m[2]) > depth]
        for m in members:
            out[m[0]] = share
        if not rest or not 0 < bad < n:
            return
        children = {}
        for m in rest:
            children.setdefault(m[2][depth], []).append(m)
        _, pb, pl = rate([m[0] for m in rest], 0)
        groups = {}
        for name, own in children.items():
            _, b, k = rate([m[0] for m in own], 0)
            pooled = pb / pl if pl else None
            z = abs(b / k - pooled) / (max(pooled * (1 - pooled), 0.01) / k) ** 0.5 if k and pl else 0
            groups.setdefault(name if z > u.MERGE_Z else None, []).extend(own)
        for own in groups.values():
            s, b, k = rate([m[0] for m in own], share)
            down(own, depth + 1, s, b, k)

    for host in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == host]
        down(own, 0, *rate([r[0] for r in own], top))
    return {i: "block" if s > u.REJECT_SHARE else "allow" for i, s in out.items()}


def test_verdicts_match_a_brute_force_tree(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], {}
    for i in range(3000):
        host = f"h{rng.integers(4)}.net"
        parts = [f"s{rng.integers(25)}", f"t{rng.integers(3)}", "a", "b", f"u{rng.integers(2)}", f"x{rng.integers(40)}"][: int(rng.integers(1, 7))]
        bad = parts[0] == "s3" or parts[:2] == ["s5", "t1"] or (len(parts) > 4 and parts[4] == "u1" and host == "h0.net")
        rows.append((i, host, parts))
        if rng.random() < 0.5:
            labels[i] = int(bad if rng.random() < 0.97 else not bad)
    pages = spark.createDataFrame([(i, f"http://{h}/{'/'.join(p)}") for i, h, p in rows], "page_id long, url string")
    given = spark.createDataFrame(list(labels.items()), "page_id long, bad int")
    got = {r["page_id"]: r["verdict"] for r in u.judge_urls(pages, rules=(), labels=given).collect()}
    want = brute_tree(rows, labels)
    assert got == want and {"allow", "block"} <= set(got.values())


def test_labels_of_one_side_do_not_block_the_rest(spark):
    pages = spark.createDataFrame([(1, "http://spam.net/a"), (2, "http://spam.net/b"), (3, "http://fine.net/a"), (4, "http://clean.edu/b")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in u.judge_urls(pages, rules=()).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}
