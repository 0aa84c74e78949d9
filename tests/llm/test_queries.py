"""Text queries against their SQL on the smallest tables."""

import pytest

from conftest import DATA, assert_same
from furrow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"licence_spans", "aligned_token_pairs"}))
def test_one_row_a_document(spark, name):
    assert QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_spans_are_those_of_the_scan(spark):
    from furrow.llm import licences

    scan = licences.Scanner()
    want = sorted((r.doc_id, s.label, s.first_word, s.last_word, s.edits) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for s in scan.scan((r.text or "").encode())[1])
    got = sorted(tuple(r) for r in QUERIES["licence_spans"](spark, DATA).select("doc_id", "label", "first_word", "last_word", "edits").collect())
    assert got == want and got
