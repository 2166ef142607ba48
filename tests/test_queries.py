"""Bound queries against their SQL twins on the smallest tables.

By default one query in each family; all of them with TALLYSCOPE_ALL=1.
"""

import os
import re

import pytest

from tallyscope import bindings

from .oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in bindings.load().items() if q.oracle}


def chosen():
    if os.environ.get("TALLYSCOPE_ALL"):
        return sorted(QUERIES)
    first = {}
    for n in sorted(QUERIES):
        first.setdefault(re.match(r"[a-z]+", n).group(), n)
    return sorted(first.values())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", chosen())
def test_query_matches_sql(spark, con, name):
    problem, _ = compare(QUERIES[name].run(bindings.Tables(spark, FOLDER)), con, QUERIES[name].oracle)
    assert not problem


def test_names_and_coverage():
    known = bindings.load()
    assert len(known) > 150
    families = {re.match(r"[a-z]+", n).group() for n in known}
    assert {"src", "snk", "f", "j", "a", "w", "l", "u", "x", "st", "g", "m", "d", "p", "r", "ge", "k", "e", "c", "s"} <= families
