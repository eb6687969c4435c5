import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from factloom.plans import features, suite
from factloom.plans.graph import table
from oracle import check

SMALL = "/root/testdata/sf0.001"
QUERIES = features.QUERIES | suite.QUERIES
ORACLES = features.ORACLES | suite.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SMALL)


def test_suite_is_complete():
    assert len(suite.QUERIES) == 104
    assert QUERIES.keys() <= entry.queries().keys()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 150


def test_ngrams_of_whole_texts(spark):
    expected = Counter()
    for r in table(spark, SMALL, "benchmark").collect():
        for w in re.findall(r"[^\W_]+", (r.text or "").lower()):
            expected.update(w[i : i + 3] for i in range(max(len(w) - 2, 1)))
    assert {r.term: r.n for r in QUERIES["ngram_tokens"](spark, SMALL).collect()} == expected


def test_history_holds_every_order(spark):
    held = QUERIES["history_checkout_ancestors"](spark, SMALL)
    assert held.count() == table(spark, SMALL, "orders").select("o_orderkey").distinct().count()
