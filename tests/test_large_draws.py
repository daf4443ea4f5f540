import pytest

from runlens.operators import statistics
from runlens.plans import catalogue

from .test_twins import SF


@pytest.mark.parametrize("name", ["resource_interval", "gate_checks", "paired_bootstrap", "regression_decisions", "compare_runs"])
def test_draws_of_a_large_group_are_no_rows(spark, monkeypatch, name):
    """With every group counted as large, nothing is exploded by resamples or joined to its draws."""
    monkeypatch.setattr(statistics, "resampled", None)
    monkeypatch.setattr(statistics, "SMALL_DRAWS", 0, raising=False)
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_poisson_weights_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(statistics, "poisson_draw", None)
    assert catalogue.QUERIES["poisson_bootstrap"](spark, SF).count() > 0
