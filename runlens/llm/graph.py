"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, Scratch, bounded_broadcast

#: Nodes whose smallest neighbours are broadcast; more are joined by a shuffle, which splits very common nodes.
MAX_BROADCAST_NODES = 300_000
#: Links (16 bytes each) that one task may finish.
MAX_LOCAL_LINKS = 1_000_000


def forest(a: Any, b: Any) -> tuple[Any, Any]:
    """Fewer links that connect the same nodes: every node to the smallest one of its group here."""
    import numpy as np

    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        low, new = np.minimum(la, lb), label.copy()
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _whole_forest(source: Iterator[Any]) -> Iterator[Any]:
    import numpy as np

    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in source if b.num_rows]
    if got:
        a, b = forest(*(np.concatenate([x[i] for x in got]) for i in range(2)))
        yield from pairs_out(a, b, "node", "root")


def pairs_out(a: Any, b: Any, first: str, second: str) -> Iterator[Any]:
    import pyarrow as pa

    for at in range(0, len(a), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + BATCH_ROWS]), pa.array(b[at : at + BATCH_ROWS])], names=[first, second])


def components(links: DataFrame, scratch: Scratch, max_local_links: int = MAX_LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node of links(a long, b long) other than roots: root is the smallest node it can reach.

    While there are more than max_local_links links, each round hooks the larger neighbours of a node to its
    smallest neighbour, then the smaller ones likewise; every such round lowers the number of links towards one per
    node, and their number grows with the logarithm of the longest chain. Links are written between the rounds, and
    so is each table of smallest neighbours, so that a join with a very common node has two shuffled inputs that
    can be split. As soon as the counted links are few enough, one task finishes them. Rounds go on until nothing
    changes. Null ends and self-links are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
    edges = scratch.write(edges, "edges0")
    state = _state(edges)
    for i in count(1):
        if state[0] <= max_local_links:
            return scratch.write(edges.repartition(1).mapInArrow(_whole_forest, "node long, root long"), "roots") if state[0] else edges.select("node", F.col("to").alias("root"))
        both = edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = scratch.write(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")), f"least{i}")
        large = both.join(bounded_broadcast(least, MAX_BROADCAST_NODES), "node").where("to > node").select(F.col("to").alias("node"), F.col("root").alias("to"))
        down = scratch.write(large.where("node <> to").distinct(), f"down{i}")
        least = scratch.write(down.groupBy("node").agg(F.min("to").alias("root")), f"roots{i}")
        small = down.join(bounded_broadcast(least, MAX_BROADCAST_NODES), "node").select(F.col("to").alias("node"), F.col("root").alias("to")).where("node <> to")
        after = scratch.write(small.unionByName(least.select("node", F.col("root").alias("to"))).distinct(), f"edges{i}")
        scratch.drop(f"edges{i - 1}", f"least{i}", f"down{i}", f"roots{i}")
        edges, before, state = after, state, _state(after)
        if state == before:
            return edges.select("node", F.col("to").alias("root"))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Rows and a checksum: when a round changes neither, every link is a star."""
    n, check = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "to"))).first()
    return n, check or 0
