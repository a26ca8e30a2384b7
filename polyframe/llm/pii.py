"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidates: the four base kinds in their exact form, near misses of these, and
further forms (spelled-out addresses, national telephone numbers, identity numbers, credentials,
and card numbers that a base match runs past).
Three labelers vote 1, 0 or -1 on each candidate: its regex form, gazetteers (lists of endings,
prefixes and ranges), and the words before it. Votes are counted by pattern - at most ``PATTERNS``
rows, whatever the input - and on these counts expectation-maximisation estimates how reliable each
labeler is. Its posteriors train the final span classifier, a logistic function of votes, kind and
surroundings, which is evaluated as a column expression. Candidates of base form are always spans;
the others are where the classifier is sure.

Places count code points from 0, ends exclusive. They come from the lengths of what stands between
matches and of the matches, so a text is passed once for each pattern, whatever the number of spans.
Spans are looked up in blocks that know where they start and end, so texts with many spans take
little more than their share of time.

Defined results: a null or empty text has no spans; texts of any length are searched whole;
repeated rows and equal or null ids each keep their row; spans that start together are ordered by
kind, as listed in ``KINDS``, then by end; an empty table gives no row; columns other than the id
and the text are ignored by ``detect`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = KINDS[:4]
#: Code points before a candidate that the context labeler reads.
CONTEXT = 40
#: Probability from which the classifier adds a candidate.
SURE = 0.95
#: Upper bound of the rows of vote patterns: kinds, three votes of three values, two flags.
PATTERNS = len(KINDS) * 3**3 * 2**2
#: Code points of the pieces in which texts are redacted, spans of the blocks in which they are looked up.
PIECE, BLOCK = 4096, 64

LOCAL = "A-Za-z0-9._%+-"
RUN = r"(?:(?<![{0}])|\G)"
#: Kind and pattern of each proposal. All quantifiers that can be are possessive, and a match starts
#: where a run starts or the last match ended, so time is linear in the text; the matches are those
#: of the plain patterns.
PROPOSALS = (
    ("email", RUN.format(LOCAL) + rf"[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("ip", RUN.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", r"(?i)(?<![\p{L}0-9._%+-])[A-Z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Z0-9-]{2,64}+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Z0-9-]{2,64}+)++"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|token|secret|api_?key) ?[=:] ?\"?)[A-Za-z0-9+/_-]{12,}+\"?"),
    ("card", r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
)
#: What a text must hold before a pattern is tried on it.
NEEDS = (
    lambda t: F.contains(t, F.lit("@")),
    lambda t: t.rlike(r"[0-9]\.[0-9]"),
    lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    lambda t: F.contains(t, F.lit("+")),
    lambda t: t.rlike(r"(?i) dot |[(\[]dot[)\]]"),
    lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    lambda t: F.contains(t, F.lit("AKIA")) | t.rlike(r"(?i)(?:password|passwd|token|secret|api_?key) ?[=:]"),
    lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
)
#: Words before a candidate that speak for its kind, and words that speak against any.
FOR = {
    "email": r"mail|contact|write|address|from:|to:",
    "ip": r"\bip\b|address|host|server|login|client",
    "card": r"card|visa|master|amex|credit|debit|account|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|mobile|cell|fax|whatsapp|sms",
    "id": r"ssn|social|identity|\bid\b|passport|tax",
    "secret": r"key|password|secret|token|credential|login|aws",
}
AGAINST = r"version|isbn|issn|doi|section|chapter|page|release|build|order no|license|licence|python|\bv$"
#: Gazetteers: endings of hosts, ranges that belong to no person, issuer and country prefixes, key prefixes.
ENDINGS = r"(?i)(?:\.|dot[)\]]? ?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|ch|at|eu|us|ca|au|jp|cn|in|br|mx)$"
RESERVED = r"^0*(?:0|10|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*192\.0*168\.|^0*169\.0*254\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    from_right = F.split(F.reverse(digits), "")
    worth = F.transform(F.filter(from_right, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _strict(proposal: int, hit: Column) -> Column:
    """Whether a match of a base pattern passes the base check; further forms only propose."""
    digits = _digits(hit)
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.lit(True),
        hit.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        F.length(digits).between(14, 19) & _luhn(digits),
        F.length(digits).between(10, 15),
    )[proposal]


def _form(proposal: int, hit: Column, base: Column) -> Column:
    """Vote of the regex labeler."""
    if proposal < len(BASE):
        return F.when(base, 1).otherwise(-1)
    if PROPOSALS[proposal][0] == "secret":
        mixed = hit.rlike("[0-9]") & (F.length(hit) >= 20)
        return F.when(mixed, 1).otherwise(0)
    if PROPOSALS[proposal][0] == "card":
        return F.when(_luhn(_digits(hit)), 1).otherwise(-1)
    return F.lit(1)


def _listed(kind: str, hit: Column) -> Column:
    """Vote of the gazetteer labeler."""
    if kind == "email":
        return F.when(hit.rlike(ENDINGS), 1).otherwise(0)
    if kind == "ip":
        return F.when(hit.rlike(RESERVED), -1).otherwise(1)
    if kind == "card":
        return F.when(_digits(hit).rlike(ISSUERS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(hit.startswith("+") & _digits(hit).rlike(COUNTRIES), 1).otherwise(0)
    if kind == "id":
        return F.when(hit.rlike("^(?:000|666|9)|-00-|-0000$"), -1).otherwise(1)
    return F.when(hit.rlike("^AKIA"), 1).otherwise(0)


def _context(kind: str, before: Column) -> Column:
    """Vote of the context labeler."""
    low = F.lower(before)
    return F.when(low.rlike(FOR[kind]), 1).when(low.rlike(AGAINST), -1).otherwise(0)


def running(values: Column) -> Column:
    """Running sums of an array, in blocks, so that time stays near-linear for very long arrays."""
    empty = F.array().cast("array<int>")

    def sums(block: Column, first: Column) -> Column:
        return F.slice(F.aggregate(block, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, 1 << 30)

    def long(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 256).cast("int")), lambda b: F.slice(v, b * 256 + 1, 256))
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, F.concat(F.array(F.lit(0)), F.slice(sums(total, F.lit(0)), 1, F.size(total) - 1)), sums))

    return F.when(F.size(values) == 0, empty).when(F.size(values) <= 256, sums(values, F.lit(0))).otherwise(long(values))


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__found``: array of (start, kind, end, base, form, listed, context, glued, assigned) in order."""
    n = range(len(PROPOSALS))
    frame = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    frame = frame.withColumns({f"__n{k}": NEEDS[k](F.col("__t")) for k in n})
    frame = frame.withColumns(
        {f"__p{k}": F.when(F.col(f"__n{k}"), F.split("__t", PROPOSALS[k][1], -1)) for k in n}
        | {f"__m{k}": F.when(F.col(f"__n{k}"), F.regexp_extract_all("__t", F.lit(PROPOSALS[k][1]), F.lit(0))) for k in n}
    )

    def item(part: Column, hit: Column) -> Column:
        return F.struct(F.length(part).alias("gap"), F.length(hit).alias("size"), hit.alias("hit"), F.right(part, F.lit(CONTEXT)).alias("before"))

    frame = frame.withColumns({f"__i{k}": F.zip_with(F.slice(f"__p{k}", 1, F.size(f"__m{k}")), F.col(f"__m{k}"), item) for k in n})
    # A match ends after all gaps and matches up to it.
    frame = frame.withColumns({f"__e{k}": running(F.transform(f"__i{k}", lambda i: i["gap"] + i["size"])) for k in n})

    def candidate(k: int):
        kind = PROPOSALS[k][0]

        def make(i: Column, end: Column) -> Column:
            base = _strict(k, i["hit"]) if k < len(BASE) else F.lit(False)
            return F.struct(
                (end - i["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), base.alias("base"),
                _form(k, i["hit"], base).alias("form"), _listed(kind, i["hit"]).alias("listed"), _context(kind, i["before"]).alias("context"),
                i["before"].rlike(r"[\p{L}0-9_]$").alias("glued"), i["before"].rlike("[=:] ?\"?$").alias("assigned"),
            )

        return make

    kind_of = "array<struct<start:int,kind:int,end:int,base:boolean,form:int,listed:int,context:int,glued:boolean,assigned:boolean>>"
    lists = {f"__c{k}": F.coalesce(F.zip_with(f"__i{k}", f"__e{k}", candidate(k)), F.array()).cast(kind_of) for k in n}
    frame = frame.withColumns(lists).withColumn("__found", F.array_sort(F.concat(*(F.col(f"__c{k}") for k in n))))
    return frame.drop("__t", *(f"__{x}{k}" for x in "npmiec" for k in n))


@dataclass(frozen=True)
class Classifier:
    """Logistic weights by feature; ``sure`` is None where nothing was there to learn from."""

    bias: float
    kind: tuple[float, ...]
    votes: tuple[tuple[float, float, float], ...]  # for each labeler the weights of -1, 0, 1
    glued: float
    assigned: float
    reliabilities: tuple[tuple[float, float], ...]  # P(1 | personal), P(-1 | not) of each labeler

    def score(self, c: Column) -> Column:
        pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at)
        total = F.lit(self.bias) + pick(self.kind, c["kind"] + 1)
        for name, weights in zip(("form", "listed", "context"), self.votes, strict=True):
            total += pick(weights, c[name] + 2)
        total += F.when(c["glued"], self.glued).otherwise(0.0) + F.when(c["assigned"], self.assigned).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(found: DataFrame) -> Classifier | None:
    """The span classifier from candidates in ``__found``; None without candidates."""
    by = ["kind", "form", "listed", "context", "glued", "assigned"]
    rows = found.select(F.explode("__found").alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in by)).count().collect()
    if not rows:
        return None
    assert len(rows) <= PATTERNS
    rows.sort()
    kind = np.array([r["kind"] for r in rows])
    votes = np.array([[r["form"], r["listed"], r["context"]] for r in rows]) + 1
    flags = np.array([[r["glued"], r["assigned"]] for r in rows], dtype=float)
    count = np.array([r["count"] for r in rows], dtype=float)
    posterior, tables = expectation_maximisation(kind, votes, count)
    hot = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[votes[:, j]] for j in range(3)), flags, np.ones((len(rows), 1))], axis=1)
    w = logistic(hot, posterior, count)
    k = len(KINDS)
    return Classifier(float(w[-1]), tuple(map(float, w[:k])), tuple(tuple(map(float, w[k + 3 * j : k + 3 * j + 3])) for j in range(3)), float(w[-3]), float(w[-2]), tuple((float(t[1, 2]), float(t[0, 0])) for t in tables))


def expectation_maximisation(kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, list[np.ndarray]]:
    """P(personal) of each pattern, and P(vote | class) of each labeler, classes in rows."""
    p = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))
    tables: list[np.ndarray] = []
    for _ in range(rounds):
        tables = []
        for j in range(votes.shape[1]):
            # The prior says that labelers are better than chance: it keeps the classes from swapping.
            t = np.array([[2.0, 1.0, 0.2], [0.2, 1.0, 2.0]])
            for v in range(3):
                t[:, v] += [(count * (1 - p))[votes[:, j] == v].sum(), (count * p)[votes[:, j] == v].sum()]
            tables.append(t / t.sum(axis=1, keepdims=True))
        odds = np.zeros(len(p))
        for k in set(kind.tolist()):
            own = kind == k
            share = ((count * p)[own].sum() + 1) / (count[own].sum() + 2)
            odds[own] = math.log(share / (1 - share))
        for j, t in enumerate(tables):
            odds += np.log(t[1, votes[:, j]]) - np.log(t[0, votes[:, j]])
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(after - p).max() < 1e-9
        p = after
        if done:
            break
    return p, tables


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocked(spans: Column) -> Column:
    """Ordered spans in blocks of ``BLOCK``, each with the first start and the last end in it."""
    def block(k: Column) -> Column:
        own = F.slice(spans, k * BLOCK + 1, BLOCK)
        return F.struct(own.alias("spans"), F.element_at(own, 1)["start"].alias("start"), F.array_max(F.transform(own, lambda c: c["end"])).alias("end"))

    kind = "array<struct<spans:array<struct<start:int,end:int,kind:int>>,start:int,end:int>>"
    made = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int")), block)
    return F.when(F.size(spans) == 0, F.array().cast(kind)).otherwise(made.cast(kind))


def overlapping(blocks: Column, start: Column, end: Column) -> Column:
    """The spans that meet a stretch: only blocks that meet it are looked into."""
    met = lambda c: (c["start"] < end) & (start < c["end"])
    return F.flatten(F.transform(F.filter(blocks, met), lambda b: F.filter(b["spans"], met)))


def _ends(found: Column) -> Column:
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))


def _spans(classifier: Classifier | None) -> Column:
    """Base candidates, and sure ones that overlap no base candidate."""
    found = F.col("__found")
    base = F.filter(found, lambda c: c["base"])
    if classifier is None:
        return base
    sure = F.exists(found, lambda c: ~c["base"] & (classifier.score(c) >= SURE))

    def added(blocks: Column) -> Column:
        return F.filter(found, lambda c: c["base"] | ((classifier.score(c) >= SURE) & (F.size(overlapping(blocks, c["start"], c["end"])) == 0)))

    return F.when(sure, let(blocked(_ends(base)), added)).otherwise(base)


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, SHA-256 of the base spans, all spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(_candidates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", "__found"))
    base = F.filter("__found", lambda c: c["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda c: c["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    counts = map(number, BASE)
    return found.select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(_spans(learn(found))).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans get the first one's.

    Candidates are sought once and written next to the documents; learning reads them alone.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    frame = Scratch(docs.sparkSession, "pii").keep(_candidates(docs.toDF(*names), text))
    frame = frame.withColumn("__spans", _spans(learn(frame.select("__found"))))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def piece(part: Column, number: Column, blocks: Column) -> Column:
        first = number * PIECE
        last = first + F.length(part)

        def step(state: Column, c: Column) -> Column:
            fresh = c["start"] >= state["to"]
            gap = F.when(fresh, F.substring(part, state["to"] - first + 1, c["start"] - state["to"])).otherwise("")
            mark = F.when(fresh & (c["start"] >= first), F.element_at(marks, c["kind"] + 1)).otherwise("")
            return F.struct(F.greatest(state["to"], c["end"]).alias("to"), F.concat(state["out"], gap, mark).alias("out"))

        start = F.struct(first.alias("to"), F.lit("").alias("out"))
        return F.aggregate(overlapping(blocks, first, last), start, step, lambda s: F.concat(s["out"], F.when(s["to"] < last, F.substring(part, s["to"] - first + 1, last - s["to"])).otherwise("")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    redacted = let(blocked(_ends(F.col("__spans"))), lambda blocks: F.array_join(F.transform(pieces, lambda part, number: piece(part, number, blocks)), ""))
    frame = frame.withColumn(text, F.when(F.size("__spans") > 0, redacted).otherwise(F.col(text)))
    if chars_col in docs.columns:
        chars = names[docs.columns.index(chars_col)]
        frame = frame.withColumn(chars, F.when(F.size("__spans") > 0, F.length(text).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars)))
    return frame.select(*names).toDF(*docs.columns)
