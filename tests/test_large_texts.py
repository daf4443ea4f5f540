import pytest

from runlens.plans import catalogue

from .test_twins import SF


@pytest.mark.parametrize("name", ["python_lineage", "pipeline_lineage"])
def test_one_small_file_of_texts_is_many_tasks(spark, name):
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 32
