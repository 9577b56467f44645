"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from loomtext.plans import catalogue

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_its_sql(spark, sf, name):
    assert_same(catalogue.QUERIES[name](spark, sf), sf, catalogue.ORACLE[name])


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_the_classifier_tells_the_classes_apart(spark, sf):
    got = catalogue.QUERIES["classifier_metrics"](spark, sf.replace("0.001", "0.01")).first()
    assert got.balanced_accuracy > 0.6 and got.n == 81  # always the largest class would be 0.5


def test_entry_gives_rows(spark, sf):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
