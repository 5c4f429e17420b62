"""All registered queries: against their SQL on the smallest data, and on empty tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import compare, run, views

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return views(DATA)


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


#: Queries without SQL, and the tests that check them another way.
ELSEWHERE = {
    "p6_ids": "tests/llm/test_encoding.py", "p6_token_counts": "tests/llm/test_encoding.py", "p7_found": "tests/llm/test_leakage.py", "p7_leaks": "tests/llm/test_leakage.py", "p7_items": "tests/llm/test_leakage.py",
    "p8_found": "tests/llm/test_quality.py", "p8_repetition": "tests/llm/test_quality.py", "text_functions": "tests/test_scanners.py", "edit_shapes": "tests/test_scanners.py", "mask_literals": "tests/test_scanners.py",
    "cond_stack": "tests/test_scanners.py", "guard_scope": "tests/test_scanners.py", "signature_parts": "tests/test_scanners.py", "input_classes": "tests/test_scanners.py", "taint": "tests/test_patterns.py",
}


@pytest.fixture(scope="module")
def pool():
    with ThreadPoolExecutor(6) as p:
        yield p


@pytest.fixture(scope="module")
def ran(spark, pool):
    """All queries, several at a time."""
    return {n: pool.submit(run, spark, q, DATA) for n, q in sorted(QUERIES.items())}


def test_what_has_no_sql_is_tested_elsewhere():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert set(QUERIES) - set(ORACLE) <= set(ELSEWHERE)
    assert all(os.path.exists(f"{here}/{f}") for n, f in ELSEWHERE.items() if n in QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, ran, name):
    said = compare(spark, name, QUERIES[name], ORACLE.get(name), DATA, con, ran[name].result())
    assert "DIFFERENT" not in said, said


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").limit(0).coalesce(1).write.parquet(f"{d}/{f}")
    return str(d)


#: Rows that there are even of nothing: totals, and files of folders named by hand.
FULL_OF_NOTHING: set[str] = set()


@pytest.fixture(scope="module")
def ran_empty(spark, pool, empty):
    return {n: pool.submit(run, spark, q, empty) for n, q in sorted(QUERIES.items())}


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(ran_empty, name):
    rows, _, _ = ran_empty[name].result()
    assert rows == [] or name in FULL_OF_NOTHING


@needs_data
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
