import pytest

from tarnflow.queries import core_problems, curation, reference
from tests.oracle import both

ALL = {**reference.QUERIES, **curation.QUERIES, **core_problems.QUERIES}
SQL = {**reference.SQL, **curation.SQL, **core_problems.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    left, right = both(spark, small, ALL[name], SQL[name])
    assert left == right


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_gives_rows_and_the_same_again(spark, small, name):
    first = sorted(map(str, ALL[name](spark, small).collect()))
    assert first
    if name in ("q28_best_matching", "q41b_kfold", "q62_field_pages", "q82_random_baseline", "q94_probe_output", "q95_valid_sample", "q99_head_scores", "q102_best_columns"):
        assert sorted(map(str, ALL[name](spark, small).collect())) == first


def test_entry(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
