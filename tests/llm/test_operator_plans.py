"""Plans of the training-data operators: native ones run no Python, none compares all pairs."""

import pytest

from polyframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    made = {}
    for name, query in QUERIES.items():
        frame = query(spark, FOLDER)
        made[name] = frame._jdf.queryExecution().executedPlan().toString()
    return made


def test_native_operators_run_no_python(plans):
    for number in (3, 9, 10):
        text = next(t for n, t in plans.items() if n.startswith(f"op{number}_"))
        assert not [x for x in ("Python", "Pandas", "Arrow", "ExistingRDD") if x in text]


def test_nothing_compares_all_pairs(plans):
    for text in plans.values():
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_token_operators_do_not_shuffle(plans):
    for number in (5, 6):
        assert "Exchange" not in next(t for n, t in plans.items() if n.startswith(f"op{number}_"))


def test_texts_are_the_only_columns_read(plans):
    text = next(t for n, t in plans.items() if n.startswith("op6_"))
    assert "struct<doc_id:bigint,text:string>" in text
