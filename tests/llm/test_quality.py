import random
import zlib

import pytest

from polyframe.llm import quality


def labelled(n=400, seed=0):
    rnd = random.Random(seed)
    words = ["the", "house", "of", "stone", "rivers", "run", "under", "old", "bridges", "and", "children", "watch", "boats", "pass"]
    rows = []
    for k in range(n):
        good = rnd.random() < 0.7
        if good:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(30, 200))) + "."
        else:
            text = "".join(rnd.choice("BUY NOW!! CLICK $$$ ### ") for _ in range(rnd.randrange(200, 900)))
        rows.append((k, text, int(good)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = labelled()
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), 0.5, 1) for k, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, c0 int")
    labels = spark.createDataFrame([(k, q, 0) for k, _, q in rows], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache(), {k: q for k, _, q in rows}


def test_held_out_accuracy(frames):
    docs, labels, truth = frames
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_held_out_labels_do_not_matter(spark, frames):
    docs, labels, _ = frames
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda known: sorted((r["doc_id"], r["score"]) for r in quality.classify(docs, known).collect())
    assert scores(labels) == scores(turned)


def test_other_columns_and_odd_rows(spark, frames):
    docs, labels, _ = frames
    long = " ".join(t for _, t, q in labelled(600, 9) if q)
    odd = spark.createDataFrame([(None, "text", None, None, 1, 0.0, 2), (-1, None, None, None, 0, 0.0, 2), (-2, "", None, None, 0, 0.0, 2), (-3, long, "x", "y", 0, 0.0, 2), (-3, long, "x", "y", 0, 0.0, 2)], docs.schema)
    noisy = labels.union(spark.createDataFrame([(None, 1, 0), (0, None, 0), (-3, 7, 0)], labels.schema))
    fitted = quality.fit(docs, noisy)
    assert fitted == quality.fit(docs, labels)
    got = quality.score(odd, fitted, ["doc_id", "c0", "lang"]).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"doc_id", "c0", "lang", "score"} and {r["c0"] for r in got} == {2}
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[-1] == scores[-2] >= 0.7 and scores[-3] >= 0.7
    held = {r["doc_id"]: r["held_out"] for r in quality.classify(odd, labels).collect()}
    assert held[None] is False
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_contradicting_labels_are_not_learned(spark, frames):
    docs, labels, _ = frames
    both = labels.unionByName(labels.withColumn("quality", 1 - labels["quality"]))
    assert quality.fit(docs, both) == (None, 0, 0)


@pytest.mark.parametrize(("known", "expected"), [([], 1.0), ([(1, 1)], 1.0), ([(1, 0), (3, 0)], None)])
def test_labels_of_one_kind(spark, frames, known, expected):
    docs, _, _ = frames
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    own = [k for k, _ in known if zlib.crc32(str(k).encode()) % 4 != 2]
    scores = {r["score"] for r in quality.classify(docs, labels).collect()}
    assert scores == {expected if expected is not None else 1 / (len(own) + 1)}


def test_empty_texts_score_the_share_of_good_labels(spark, frames):
    docs, labels, truth = frames
    known = [q for k, q in truth.items() if zlib.crc32(str(k).encode()) % 4 != 2]
    fitted = quality.fit(docs, labels)
    scorer = quality.Scorer(fitted[0])
    assert scorer.score(None) == scorer.score("") == pytest.approx(sum(known) / len(known), abs=1e-9)
    assert abs(scorer.score("a") - scorer.score("")) < 0.05  # a letter says next to nothing


def test_held_out_accuracy_on_documents(spark):
    """Of the labelled documents that nothing was learned from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 500
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)
    good = [r["predicted"] for r in got if r["quality"] == 1]
    assert sum(good) >= 0.99 * len(good)
