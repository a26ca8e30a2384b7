"""URL filtering by association rules, in DataFrame functions and Spark's FP-growth.

URLs that stated rules judge are the labelled ones. FP-growth mines combinations of URL tokens
with these labels; rules that predict a label stay if support and confidence reach their bounds and
no rule with fewer tokens predicts the same at least as surely. Labels come from what the stated
rules happen to name, so a rule must also discriminate to be used: its confidence exceeds the share
of its label by ``LIFT``, and of all URLs that it would judge at least ``COVERAGE`` are labelled
(`host=com` is not, where only a corner of one host in it is). An inverted index from each rule's
rarest token finds the rules that can match a URL; the surest match decides where no stated rule does.

No rule that reaches the bounds is left out. FP-growth makes every combination of a URL's frequent
tokens, so it mines where no labelled URL has more than ``MOST_TOKENS`` of them. Where one has more,
the same rules are mined by levels: a combination grows only while each part of it is met more often
than it and a verdict of it is not yet sure, since a rule with a part that predicts at least as surely
is pruned in any case. Up to ``MOST_RULES`` rules are tried in one expression, more by joins.

Defined results: a null URL, or one without ``://``, has empty host and path, matches no rule and is
allowed unless mined rules of its tokens say otherwise; texts of any length are read whole; repeated
rows and equal or null ids each keep their row; among mined rules of equal confidence the one of
higher support, then of more tokens, decides, and then "block"; without labelled URLs nothing is
mined; URLs that neither a stated nor a mined rule judges are allowed; an empty table gives no row;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path): the rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LIFT, COVERAGE = 0.01, 0.9, 1.05, 0.5
#: Frequent tokens of a URL up to which FP-growth mines (at most 2^10 / support itemsets follow), and rules of one expression.
MOST_TOKENS, MOST_RULES = 10, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def stated(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest stated rule that fits; both null if none does."""
    rule = verdict = None
    for said, own, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule = F.when(fits, own + start) if rule is None else rule.when(fits, own + start)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host endings, first path segment, file ending, query keys."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(8))), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")))
    first = F.regexp_extract(path, "^/([^/]*)/", 1)
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.element_at(F.split(x, "=", 2), 1)))
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.when(url.contains("://"), F.array(F.concat(F.lit("scheme="), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)))).otherwise(none),
            F.when(F.size(labels) > 0, endings).otherwise(none),
            F.when(first != "", F.array(F.concat(F.lit("dir="), first))).otherwise(none),
            F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(none),
            keys,
        )
    )


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    anchor: str


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, most: int | None = None) -> list[Rule]:
    """All pruned rules from ``labelled`` (tokens, verdict). A caller that wants at most ``most`` gets those of a doubled support bound."""
    n = labelled.count()
    if not n:
        return []
    # Tokens below the support bound are in no rule; what is left is at most tokens / support of them.
    held = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= support * n)
    frequency = {r["token"]: r["count"] for r in held.collect()}
    if not frequency:
        return []
    order = sorted(frequency, key=lambda t: (-frequency[t], t))
    known = F.create_map(*(x for k, t in enumerate(order) for x in (F.lit(t), F.lit(k))))
    ranks = F.array_sort(F.transform(F.filter("tokens", lambda t: F.map_contains_key(known, t)), lambda t: F.element_at(known, t)))
    scratch = Scratch(labelled.sparkSession, "mining")
    read = scratch.keep(labelled.select(ranks.alias("ranks"), "verdict"))
    by_growth = read.agg(F.max(F.size("ranks"))).first()[0] <= MOST_TOKENS
    while True:
        found = (_grown if by_growth else _levels)(read, order, support, confidence, n)
        if most is None or len(found) <= most:
            break
        support *= 2
    scratch.clear()
    return [Rule(own, verdict, sure, share, min(own, key=lambda t: (frequency[t], t))) for own, verdict, sure, share in found]


def _grown(read: DataFrame, order: list[str], support: float, confidence: float, n: int) -> list[tuple]:
    """Pruned rules (tokens, verdict, confidence, support) by FP-growth on ``read`` (ranks, verdict); a rank is a token's place in ``order``."""
    names = F.array(*map(F.lit, order))
    items = read.select(F.array_append(F.transform("ranks", lambda k: F.get(names, k)), F.concat(F.lit(LABEL), "verdict")).alias("items"))
    label = F.element_at("consequent", 1)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(label.startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rows = found.select(F.array_sort("antecedent").alias("tokens"), label.alias("label"), "confidence", "support").collect()
    kept: dict[tuple[str, frozenset], tuple] = {}
    for r in sorted(rows, key=lambda r: (len(r["tokens"]), r["tokens"], r["label"])):
        own, verdict = r["tokens"], r["label"].removeprefix(LABEL)
        fewer = (kept.get((verdict, frozenset(part))) for m in range(1, len(own)) for part in combinations(own, m))
        if not any(k is not None and k[2] >= r["confidence"] for k in fewer):
            kept[verdict, frozenset(own)] = (tuple(own), verdict, r["confidence"], r["support"])
    return list(kept.values())


def _levels(read: DataFrame, order: list[str], support: float, confidence: float, n: int) -> list[tuple]:
    """The same rules, level by level, from the combinations that pruning leaves alive."""
    scratch = Scratch(read.sparkSession, "levels")
    # Equal URLs are counted once; a combination grows by tokens of higher rank, so each is made once for a URL.
    distinct = scratch.keep(read.groupBy("ranks", "verdict").agg(F.count("*").alias("n")))
    met = distinct.select("ranks", "verdict", "n", F.explode("ranks").alias("k")).select("ranks", "verdict", "n", F.array("k").alias("own"))
    kept: list[tuple] = []
    #: Of the combinations of the last level: how often they are met, and by verdict the best confidence of them and their parts.
    alive: dict[tuple, tuple[int, dict[str, float]]] = {}
    first, table = True, None
    while True:
        level = scratch.keep(met)
        if table is not None:
            scratch.drop(table)
        table = level
        summed = level.groupBy("own", "verdict").agg(F.sum("n").alias("n"))
        frequent = summed.groupBy("own").agg(F.collect_list(F.struct("verdict", "n")).alias("by"), F.max("n").alias("most")).where(F.col("most") >= support * n)
        now: dict[tuple, tuple[int, dict[str, float]]] = {}
        for r in frequent.collect():
            own, by = tuple(r["own"]), {x["verdict"]: x["n"] for x in r["by"]}
            count = sum(by.values())
            parts = [] if first else [alive.get(own[:k] + own[k + 1 :]) for k in range(len(own))]
            if any(p is None or p[0] <= count for p in parts):
                continue  # a part is dead, or says the same of the same URLs
            best = {}
            for verdict, c in by.items():
                # A verdict that is open here is open in every part: one that lacks it is sure of it, or too rare.
                if c < support * n or any(verdict not in p[1] for p in parts):
                    continue
                before, sure = max((p[1][verdict] for p in parts), default=0.0), c / count
                if sure >= confidence and sure > before:
                    names = tuple(sorted(order[k] for k in own))
                    kept.append((names, verdict, sure, c / n))
                if max(before, sure) < 1:
                    best[verdict] = max(before, sure)
            if best:
                now[own] = (count, best)
        if not now:
            break
        alive, first = now, False
        living = _table(read.sparkSession, [{"a": own} for own in now], "a array<int>")
        rest = F.filter("ranks", lambda k: k > F.element_at("own", -1))
        met = level.join(living, F.col("own") == F.col("a"), "left_semi").select("ranks", "verdict", "n", "own", F.explode(rest).alias("k")).select("ranks", "verdict", "n", F.array_append("own", F.col("k")).alias("own"))
    scratch.clear()
    return sorted(kept, key=lambda r: (len(r[0]), r[0], r[1]))


def discriminating(rules: list[Rule], urls: DataFrame, lift: float = LIFT, coverage: float = COVERAGE) -> list[Rule]:
    """Those rules that tell labels apart and whose labels stand for what they would judge; ``urls`` has tokens and stated, null if unlabelled."""
    if not rules:
        return []
    shares = {r["stated"]: r["count"] for r in urls.where("stated is not null").groupBy("stated").count().collect()}
    share = {verdict: n / sum(shares.values()) for verdict, n in shares.items()}
    rules = [r for r in rules if r.confidence >= min(1.0, lift * share[r.verdict]) and share[r.verdict] < 1]
    if not rules:
        return []
    labelled = F.col("stated").isNotNull().alias("labelled")
    if len(rules) <= MOST_RULES:
        index = _index(rules, lambda k, r: F.struct(F.lit(k).alias("rule"), F.array(*map(F.lit, r.tokens)).alias("tokens")))
        met = urls.select(labelled, F.explode(_met(F.col("tokens"), index)).alias("r")).select("labelled", "r.rule")
    else:
        met = _joined(urls.select("tokens", labelled), rules)
    counts = {r["rule"]: r["labelled"] / r["n"] for r in met.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("labelled").alias("labelled")).collect()}
    return [r for k, r in enumerate(rules) if counts.get(k, 0) >= coverage]


def _index(rules: list[Rule], entry: Callable[[int, Rule], Column]) -> Column:
    """The inverted index: from a token to the entries of the rules that it anchors."""
    by_anchor: dict[str, list[Column]] = {}
    for k, r in enumerate(rules):
        by_anchor.setdefault(r.anchor, []).append(entry(k, r))
    return F.create_map(*(x for token, own in by_anchor.items() for x in (F.lit(token), F.array(*own))))


def _met(tokens: Column, index: Column) -> Column:
    """Entries of the rules whose tokens are all there."""
    found = F.flatten(F.transform(F.filter(tokens, lambda t: F.map_contains_key(index, t)), lambda t: F.element_at(index, t)))
    return F.filter(found, lambda r: F.forall(r["tokens"], lambda t: F.array_contains(tokens, t)))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A frame of the driver's rows in one literal, which needs no Python on executors."""
    inner = ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in schema.split(", ")))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{inner}>>")))


def _joined(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each of ``urls`` (tokens and more) with each rule whose tokens are all there, by a join on the rules' anchors."""
    rows = [{"rule": k, "anchor": r.anchor, "own": r.tokens, "confidence": r.confidence, "support": r.support, "said": r.verdict} for k, r in enumerate(rules)]
    table = _table(urls.sparkSession, rows, "rule int, anchor string, own array<string>, confidence double, support double, said string")
    met = urls.withColumn("token", F.explode("tokens")).join(table, F.col("token") == F.col("anchor"))
    return met.where(F.size(F.array_except("own", "tokens")) == 0)


def with_mined(read: DataFrame, rules: list[Rule]) -> DataFrame:
    """``read`` (tokens and more) with ``mined``, the verdict of the surest mined rule that matches."""
    if len(rules) <= MOST_RULES:
        return read.withColumn("mined", mined(F.col("tokens"), rules))
    best = F.max(F.struct("confidence", "support", F.size("own").alias("n"), F.col("said").alias("verdict")))["verdict"]
    found = _joined(read.select("tokens").distinct(), rules).groupBy(F.col("tokens").alias("known")).agg(best.alias("mined"))
    return read.join(found, F.col("tokens") == F.col("known"), "left").drop("known")


def mined(tokens: Column, rules: list[Rule]) -> Column:
    """Verdict of the surest mined rule that matches; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    index = _index(rules, lambda _, r: F.struct(F.array(*map(F.lit, r.tokens)).alias("tokens"), F.lit(r.confidence).alias("confidence"), F.lit(r.support).alias("support"), F.lit(r.verdict).alias("verdict")))
    fits = _met(tokens, index)
    return F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"].alias("confidence"), r["support"].alias("support"), F.size(r["tokens"]).alias("n"), r["verdict"].alias("verdict"))))["verdict"]


def judge(pages: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and whether the verdict was mined."""
    scratch = Scratch(pages.sparkSession, "urls")
    parts = pages.select("page_id", F.col("url").alias("u"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = stated(F.col("host"), F.col("path"), rules)
    read = scratch.keep(parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("stated"), F.coalesce(tokens(F.col("u"), F.col("host"), F.col("path")), F.array()).alias("tokens")))
    learned = mine(read.where("stated is not null").select("tokens", F.col("stated").alias("verdict")), support, confidence)
    learned = discriminating(learned, read)
    said = with_mined(read, learned)
    return said.select("page_id", "host", "path", "rule", F.coalesce("stated", "mined", F.lit("allow")).alias("verdict"), (F.col("stated").isNull() & F.col("mined").isNotNull()).alias("by_mined_rule"))
