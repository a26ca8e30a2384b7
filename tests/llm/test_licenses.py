import random

import pytest

from polyframe.llm import licenses
from polyframe.llm.templates import TEMPLATES


def brute(text):
    words, out = licenses.words_of(text or ""), {}
    for own in licenses.classes(TEMPLATES):
        for at in range(0, max(1, len(words)), own.stride):
            held = set(licenses.shingles_of(words[at : at + own.window]))
            for name, shingles in own.templates:
                share = len(held & set(shingles)) / len(shingles)
                if share >= licenses.SHARE:
                    best, n = out.get(name, (0, 0))
                    out[name] = (max(best, share), n + 1)
    return out


def document(rnd):
    parts = []
    for _ in range(rnd.randrange(6)):
        words = rnd.choice(list(TEMPLATES.values())).split()
        if rnd.random() < 0.5:
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(["foo", "license", "Bär"])
        if rnd.random() < 0.3:
            words = words[rnd.randrange(5) :]
        parts += [rnd.choice(["the", "of", "license", "x-y"])] * rnd.randrange(40) + words
    return " ".join(parts)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(k, document(rnd)) for k in range(250)]
    rows += [(1000, None), (1001, ""), (1002, "license " * 20000), (1003, "MIT License"), (1004, " ".join([*TEMPLATES.values()] * 20)), (1005, "license" * 20000), (1006, "released UNDER\tthe...MIT licensE"), (1007, "Ébé released under the MIT License é")]
    frame = spark.createDataFrame([(*r, 1, ["x"]) for r in rows], "doc_id long, text string, class int, shingles array<string>").repartition(3)
    got = {}
    for r in licenses.scan(frame).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["containment"], r["n_windows"])
    assert got == {i: b for i, t in rows if (b := brute(t))}
    assert got[1006]["mit-notice"][0] == 1.0


def test_repeated_and_null_ids_are_one_document(spark):
    text = "Released under the MIT License."
    frame = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_windows"]) for r in licenses.scan(frame).collect()) == [("1", 2), ("None", 2)]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_anchors_are_in_any_share_of_a_template():
    chosen = licenses.anchors(TEMPLATES)
    for text in TEMPLATES.values():
        shingles = licenses.shingles_of(licenses.words_of(text))
        bare = [s for s in shingles if not set(s.split()) & set(chosen)]
        assert len(bare) < licenses.SHARE * len(shingles)


def test_bands_miss_rarely():
    for own in licenses.classes(TEMPLATES):
        assert (1 - own.least_jaccard()) ** licenses.BANDS < 1e-4


def test_large_template_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 1)
    frame = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert licenses.scan(frame).count() == 1


def test_short_templates_are_refused():
    with pytest.raises(ValueError, match="fewer"):
        licenses.classes({"x": "too short"})


@pytest.mark.parametrize("miss", [1e-4, 1e-8, 1e-15])
def test_bands_follow_from_the_templates(monkeypatch, miss):
    monkeypatch.setattr(licenses, "MISS", miss)
    number = licenses.bands_of(TEMPLATES)
    least = min(own.least_jaccard() for own in licenses.classes(TEMPLATES))
    assert number >= licenses.BANDS and (1 - least) ** number <= miss
    assert number == licenses.BANDS or (1 - least) ** (number - 1) > miss
    assert licenses.bands_of({}) == licenses.BANDS
