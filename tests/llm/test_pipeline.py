"""The corpus pipeline, stage by stage, and the registry with and without the subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from polyframe.llm import bpe, pii, quality, simhash

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage and after the last."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(base / str(k)))
        docs = spark.read.parquet(str(base / str(k)))
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model, n0, n1 = quality.fit(stages[0], labels)
    scorer = quality.Scorer(model)
    kept = {r["doc_id"] for r in stages[0].collect() if scorer.score(r["text"]) >= quality.THRESHOLD}
    assert {r["doc_id"] for r in stages[1].collect()} == kept
    assert 0 < len(kept) < stages[0].count()


def test_dedup_stage(stages):
    rows = stages[1].collect()
    prints = [int.from_bytes(simhash.fingerprint(r["text"]), "big") for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(map(min, groups.values()))


def test_pii_stage(stages):
    before = {r["doc_id"]: r for r in stages[2].collect()}
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(stages[2]).collect()}
    after = stages[3].collect()
    assert len(after) == len(before)
    for r in after:
        text, out, at = before[r["doc_id"]]["text"], "", 0
        for kind, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
    assert any(spans.values())


def test_packing_stage(stages):
    codec = bpe.Codec(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    sizes = {r["doc_id"]: len(codec.encode(r["text"])) + 1 for r in stages[3].collect()}
    pieces = {}
    for p in stages[4].collect():
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
    assert set(pieces) == set(sizes)
    for doc, own in pieces.items():
        at = 0
        for start, n, total in sorted(own):
            assert start == at and total == sizes[doc]
            at += n
        assert at == sizes[doc]


def test_run_is_the_stages_in_turn(spark, stages):
    key = lambda f: sorted((r["doc_id"], r["doc_tokens"]) for r in f.groupBy("doc_id").agg({"doc_tokens": "max"}).toDF("doc_id", "doc_tokens").collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(stages[4])


def test_repeated_and_missing_ids(spark):
    rows = [(1, "some words that are long enough to matter here", "en", "a", 1), (1, "quite another text of no relation at all to that", "en", "b", 2), (None, "x y z", "en", "c", 3), (None, "x y z", "en", "c", 3), (4, None, None, None, None), (5, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "4", "None", "None"]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), FOLDER).count() == 0


def test_registry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [n for n in e.queries() if n.startswith('op') or n == 'pipeline'])"], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, check=True)
    assert said.stdout.strip().endswith("[]")


def test_registry_with_the_subpackage():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
