r"""License texts in documents, by MinHash bands and exact shingle containment, in DataFrame functions only.

A template is a license text or notice. Texts and templates are read as words (runs of a-z, 0-9 after
lower-casing A-Z). A template is found in a text where a window of the text holds at least ``SHARE``
of the template's distinct 5-word shingles.

1. Anchor words are chosen from the templates so that any ``SHARE`` of a template's shingles holds
   one of them; texts and windows without an anchor word hold no template, and are passed over.
2. Templates are put in length classes. For each class, overlapping windows are cut from a text:
   a regular expression's lookahead captures the window while its match consumes the stride, so one
   pass makes all windows. A stretch of the class's longest template lies whole in a window.
3. Each window gets MinHash values, one a band. The Jaccard similarity J of a window and a template
   that it holds has a lower bound (``least_jaccard``), so n bands miss it with probability (1 - J)^n
   at most. n is at least ``BANDS``, and whatever the templates need for ``MISS`` or less
   (``bands_of``). Bands retrieve templates by a join.
4. Retrieved templates are verified by exact containment of shingles.

The template table is broadcast up to ``BROADCAST_ROWS`` band rows, a bound that is checked;
larger sets are joined by shuffle, whose large keys adaptive execution can split.

Defined results: a null, empty or short text holds nothing; texts of any length are scanned whole;
repeated rows and equal ids count as one document, as do rows with a null id; a template that
several windows hold is listed once, with its highest containment and the number of windows; an
empty table gives no row; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import TEMPLATES

SHINGLE, SHARE, BANDS, MISS = 5, 0.8, 48, 1e-8
BROADCAST_ROWS = 100_000
#: Ratio of the longest to the shortest template of a length class.
CLASS_RATIO = 1.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def shingles_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)))


@dataclass(frozen=True)
class Class:
    """Templates of similar length, and the windows that they are looked for in."""

    longest: int
    templates: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def stride(self) -> int:
        return max(1, self.longest // 4)

    @property
    def window(self) -> int:
        return self.longest + self.stride - 1

    def least_jaccard(self) -> float:
        """Of a window that holds ``SHARE`` of a template's shingles."""
        room = self.window - SHINGLE + 1
        return min(-(-SHARE * m // 1) / (room + m - -(-SHARE * m // 1)) for m in (len(s) for _, s in self.templates))


def classes(templates: dict[str, str]) -> list[Class]:
    by_length = sorted(((len(words_of(t)), name, tuple(shingles_of(words_of(t)))) for name, t in templates.items()), key=lambda x: (x[0], x[1]))
    out: list[list] = []
    for n, name, shingles in by_length:
        if n < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        if not out or n > CLASS_RATIO * out[-1][0][0]:
            out.append([])
        out[-1].append((n, name, shingles))
    return [Class(own[-1][0], tuple((name, s) for _, name, s in own)) for own in out]


def bands_of(templates: dict[str, str]) -> int:
    """Bands with which no window that holds a template is missed with a probability above ``MISS``."""
    least = min((own.least_jaccard() for own in classes(templates)), default=1.0)
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-least)) if least < 1 else 1)


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that any ``SHARE`` of a template's shingles holds one; long words first, few in all."""
    left = {name: [frozenset(s.split()) for s in shingles_of(words_of(t))] for name, t in templates.items()}
    size = {name: len(s) for name, s in left.items()}
    open_ = lambda: {n for n, s in left.items() if len(s) >= SHARE * size[n]}
    chosen: list[str] = []
    while todo := open_():
        gain = Counter(w for n in todo for s in left[n] for w in s if len(w) >= 6)
        if not gain:
            gain = Counter(w for n in todo for s in left[n] for w in s)
        best = max(gain, key=lambda w: (gain[w] * len(w), w))
        chosen.append(best)
        left = {n: [s for s in own if best not in s] for n, own in left.items()}
    return chosen


def _shingles(window: Column) -> Column:
    words = F.split(window, " ")
    # Of at least five words; a lambda keeps the split from being repeated.
    return F.flatten(F.transform(F.array(words), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda k: F.array_join(F.slice(w, k, SHINGLE), " ")))))


def _bands(shingles: Column, number: int) -> Column:
    def least(hashes: Column, band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band))))

    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.flatten(F.transform(F.array(hashes), lambda h: F.array(*(least(h, band) for band in range(number)))))


def windows(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class, shingles of each window that holds an anchor word."""
    anchor = "|".join(map(re.escape, anchors(templates)))
    low = F.translate(F.col(text_col), UPPER, LOWER)
    texts = docs.select(F.col(id_col).alias("doc_id"), low.alias("t")).where(F.col("t").rlike(anchor))
    plain = texts.select("doc_id", F.trim(F.regexp_replace("t", "[^a-z0-9]+", " ")).alias("t"))

    def cut(own: Class) -> Column:
        more = own.window - 1
        pattern = rf"(?<![^ ])(?=((?:[^ ]++ ){{0,{more}}}+[^ ]*+))(?:[^ ]++(?: |$)){{1,{own.stride}}}+"
        found = F.regexp_extract_all("t", F.lit(pattern), F.lit(1))
        kept = F.filter(found, lambda w: w.rlike(anchor) & (F.size(F.split(w, " ")) >= SHINGLE))
        return F.transform(kept, lambda w: F.struct(F.lit(own.longest).alias("class"), F.trim(w).alias("window")))

    cuts = plain.select("doc_id", F.explode(F.flatten(F.array(*map(cut, classes(templates))))).alias("w"))
    return cuts.select("doc_id", "w.class", _shingles(F.col("w.window")).alias("shingles")).where(F.size("shingles") > 0)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license held: doc_id, license, containment, n_windows."""
    number = bands_of(templates)
    rows = [F.struct(F.lit(own.longest).alias("tclass"), F.lit(name).alias("license"), F.array(*map(F.lit, s)).alias("tshingles")) for own in classes(templates) for name, s in own.templates]
    known = docs.sparkSession.range(1, numPartitions=1).select(F.inline(F.array(*rows)))
    table = known.select("tclass", "license", "tshingles", F.posexplode(_bands(F.col("tshingles"), number)).alias("tband", "tvalue"))
    if len(rows) * number <= BROADCAST_ROWS:
        table = F.broadcast(table)
    found = windows(docs, templates, id_col, text_col).withColumn("window", F.monotonically_increasing_id())
    banded = found.select("doc_id", "window", "class", "shingles", F.posexplode(_bands(F.col("shingles"), number)).alias("band", "value"))
    met = banded.join(table, (F.col("class") == F.col("tclass")) & (F.col("band") == F.col("tband")) & (F.col("value") == F.col("tvalue")))
    held = met.select("doc_id", "license", "window", (F.size(F.array_intersect("shingles", "tshingles")) / F.size("tshingles")).alias("containment")).where(F.col("containment") >= SHARE)
    each = held.groupBy("doc_id", "license", "window").agg(F.max("containment").alias("containment"))
    return each.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"))
