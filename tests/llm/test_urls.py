import itertools

from polyframe.llm import urls
from polyframe.llm.common import load

ODD = [None, "", "no-scheme", "://", "http://", "HTTP://Net/", "http://NET", "http://a.net/", "http://anet/", "http://x.example.net/en/1", "http://example.net/en", "http://example.net/en/?q#f", "http://org/fr/", "http://a.b.org/fr/x://y", "http://example.com/de/a#b?c", "http://myexample.com/de/a", "a://b://c/d", "http://x.org?u=://net/", "http://É.net/é", "http://" + "a." * 20000 + "net/" + "b" * 50000, "x\ny://net/\nq"]


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url[url.index("://") + 3 :]
        host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
        path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host) :]))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, verdict) for verdict, h, p in urls.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_hosts_paths_and_stated_rules(spark):
    rows = [(k, u) for k, u in enumerate(ODD)] + [(500, "http://a.net/"), (500, "http://a.net/"), (None, "http://a.net/")]
    frame = spark.createDataFrame([(*r, "host", 1) for r in rows], "page_id long, url string, host string, tokens int")
    got = urls.judge(frame).collect()
    assert len(got) == len(rows)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=str) == sorted(((i, *plain(u)[:3]) for i, u in rows), key=str)
    for r, (_, _, rule, verdict) in ((r, plain(dict(rows)[r["page_id"]])) for r in got):
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def brute_rules(labelled, support, confidence):
    """All token sets of labelled URLs, counted one by one."""
    n, count, with_label = len(labelled), {}, {}
    for tokens, verdict in labelled:
        for size in range(1, len(tokens) + 1):
            for own in itertools.combinations(sorted(tokens), size):
                count[own] = count.get(own, 0) + 1
                with_label[own, verdict] = with_label.get((own, verdict), 0) + 1
    found = {k: (c / count[k[0]], c / n) for k, c in with_label.items() if c >= support * n and c / count[k[0]] >= confidence}
    return {k: v for k, v in found.items() if not any(set(j[0]) < set(k[0]) and j[1] == k[1] and w[0] >= v[0] for j, w in found.items())}


def test_mined_rules_against_counting(spark):
    from pyspark.sql import functions as F

    frame = load(spark, "/root/testdata/sf0.001", "pages")
    parts = frame.select("url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p"))
    rule, verdict = urls.stated(F.col("h"), F.col("p"))
    labelled = parts.select(urls.tokens(F.col("url"), F.col("h"), F.col("p")).alias("tokens"), verdict.alias("verdict")).where("verdict is not null")
    rows = [(r["tokens"], r["verdict"]) for r in labelled.collect()]
    mined = {(tuple(sorted(r.tokens)), r.verdict): (r.confidence, r.support) for r in urls.mine(labelled, 0.1, 0.9)}
    expected = brute_rules(rows, 0.1, 0.9)
    assert set(mined) == set(expected) and mined
    assert all(abs(mined[k][0] - expected[k][0]) < 1e-9 for k in mined)
    # The index finds what trying every rule finds.
    rules = urls.mine(labelled, 0.1, 0.9)
    everything = parts.select(urls.tokens(F.col("url"), F.col("h"), F.col("p")).alias("tokens"))
    for r in everything.withColumn("said", urls.mined(F.col("tokens"), rules)).collect():
        fits = [(x.confidence, x.support, len(x.tokens), x.verdict) for x in rules if set(x.tokens) <= set(r["tokens"])]
        assert r["said"] == (max(fits)[3] if fits else None)


def test_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "http://a.example.xyz/q/1")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(frame).collect()] == [(1, "a.example.xyz", "/q/1", None, "allow", False)]
    assert urls.judge(frame.limit(0)).count() == 0


def parts_of(spark, folder):
    from pyspark.sql import functions as F

    frame = load(spark, folder, "pages")
    parts = frame.select("page_id", "url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p"))
    _, verdict = urls.stated(F.col("h"), F.col("p"))
    return parts.select("page_id", urls.tokens(F.col("url"), F.col("h"), F.col("p")).alias("tokens"), verdict.alias("stated"))


def test_used_rules_discriminate(spark):
    """Labels, shares and coverage counted by hand; a token of which a corner is labelled makes no rule."""
    read = parts_of(spark, "/root/testdata/sf0.01")
    rows = read.collect()
    labelled = [(set(r["tokens"]), r["stated"]) for r in rows if r["stated"]]
    rules = urls.mine(read.where("stated is not null").select("tokens", read["stated"].alias("verdict")))
    used = urls.discriminating(rules, read)
    share = {v: sum(s == v for _, s in labelled) / len(labelled) for v in ("allow", "block")}
    wanted = []
    for r in rules:
        met = [x for x in rows if set(r.tokens) <= set(x["tokens"])]
        if share[r.verdict] < 1 and r.confidence >= min(1, urls.LIFT * share[r.verdict]) and sum(x["stated"] is not None for x in met) >= urls.COVERAGE * len(met):
            wanted.append(r)
    assert used == wanted
    assert any(r.tokens == ("host=com",) for r in rules) and not any(r.tokens == ("host=com",) for r in used)


def test_held_out_precision(spark):
    """Rules mined from four fifths of the labelled URLs, on the last fifth."""
    from pyspark.sql import functions as F

    read = parts_of(spark, "/root/testdata/sf0.1").withColumn("held", F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0)
    known = read.withColumn("stated", F.when(~F.col("held"), F.col("stated")))
    rules = urls.discriminating(urls.mine(known.where("stated is not null").select("tokens", F.col("stated").alias("verdict"))), known)
    rows = read.where("held and stated is not null").select("stated", urls.mined(F.col("tokens"), rules).alias("mined")).where("mined is not null").collect()
    assert len(rows) >= 20
    assert sum(r["stated"] == r["mined"] for r in rows) >= 0.95 * len(rows)


def test_number_of_rules_is_bounded(spark):
    rows = [([f"t{(k * j) % 7}{j}" for j in range(14)], "block" if k % 3 else "allow") for k in range(60)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    assert len(urls.mine(labelled, 0.02, 0.5, most=300)) <= 300
    assert all(len(r.tokens) <= urls.MOST_TOKENS for r in urls.mine(labelled, 0.2, 0.5))


def crowd():
    """Tokens and verdicts of URLs with up to 13 frequent tokens, of which a rare one and pairs of late ones tell the verdict."""
    rows = []
    for k in range(240):
        own = [f"t{j:02}" for j in range(12) if (k * (j + 3) + j) % 7 or j < 4]
        block = ("t10" in own) != ("t11" in own) or k % 11 == 0
        rows.append((own + ["z"] * (k % 11 == 0), "block" if block else "allow"))
    return rows


def test_mining_reads_every_token_and_keeps_every_rule(spark, monkeypatch):
    """Against counting: URLs of more than MOST_TOKENS frequent tokens, and more rules than one expression tries."""
    from pyspark.sql import functions as F

    rows = crowd()
    assert max(len(own) for own, _ in rows) > urls.MOST_TOKENS
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    for support, confidence in ((0.02, 0.9), (0.01, 0.3)):
        rules = urls.mine(frame, support, confidence)
        expected = brute_rules(rows, support, confidence)
        assert {(r.tokens, r.verdict): (r.confidence, r.support) for r in rules} == expected and ("z",) in {r.tokens for r in rules}
    # FP-growth finds the same where it may mine.
    short = [([t for t in own if t not in ("t01", "t02", "t03")], verdict) for own, verdict in rows]
    short_frame = spark.createDataFrame(short, "tokens array<string>, verdict string")
    grown = urls.mine(short_frame, 0.02, 0.6)
    monkeypatch.setattr(urls, "MOST_TOKENS", 0)
    assert urls.mine(short_frame, 0.02, 0.6) == grown
    # Joins try the same rules as the expression does.
    read = frame.withColumn("stated", F.when(F.xxhash64("tokens") % 3 != 0, F.col("verdict")))
    assert len(rules) > 30
    said = sorted(map(str, urls.with_mined(read, rules).collect()))
    used = urls.discriminating(rules, read, lift=1.0, coverage=0.6)
    monkeypatch.setattr(urls, "MOST_RULES", 5)
    assert sorted(map(str, urls.with_mined(read, rules).collect())) == said
    assert 5 < len(used) < len(rules) and urls.discriminating(rules, read, lift=1.0, coverage=0.6) == used
