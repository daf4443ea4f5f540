"""Ancestry and closures follow chains to their end, or say that a given bound cut them."""

import pytest

from runlens.operators import dependencies, trace


def test_ancestry_reaches_the_end_of_a_long_chain(spark):
    links = spark.createDataFrame([("a", i, i - 1 if i else None) for i in range(206)], "g string, node long, parent long")
    starts = spark.createDataFrame([("a", 205)], "g string, node long")
    got = {(r.node, r.depth) for r in trace.ancestry(links, starts, ["g"]).collect()}
    assert got == {(205 - d, d) for d in range(206)}
    near = links.where("node <= 5")
    from_five = spark.createDataFrame([("a", 5)], "g string, node long")
    with pytest.raises(ValueError, match="max_depth"):
        trace.ancestry(near, from_five, ["g"], max_depth=4)
    assert trace.ancestry(near, from_five, ["g"], max_depth=5).count() == 6


def test_closure_says_that_a_bound_is_met(spark):
    edges = spark.createDataFrame([(str(i + 1), str(i)) for i in range(5)], "source string, target string")
    roots = spark.createDataFrame([("0",)], "id string")
    with pytest.raises(ValueError, match="max_depth"):
        dependencies.closure(edges, roots, max_depth=4)
    assert dependencies.closure(edges, roots, max_depth=5).count() == 6
