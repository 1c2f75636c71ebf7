import pytest

from tarnflow.llm import problems
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    left, right = both(spark, small, problems.QUERIES[name], problems.SQL[name])
    assert left == right


@pytest.mark.parametrize("name", sorted(set(problems.QUERIES) - set(problems.SQL)))
def test_query_without_sql_runs(spark, small, name):
    first = sorted(map(str, problems.QUERIES[name](spark, small).collect()))
    assert first
    if name in ("p2_split", "p8_bins", "p9_leaks"):  # the others are long; their operators have tests of their own
        assert sorted(map(str, problems.QUERIES[name](spark, small).collect())) == first
