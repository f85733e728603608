"""Connected components of a link table, in rounds of joins.

Each round first contracts the links that a task happens to hold (union-find over a
bounded number of links), then runs one large-star and one small-star step, so long
chains shorten by a constant factor a round. Minima are aggregated before the shuffle
and joined back, so a node with very many links doesn't meet in one task. Every round
is written to the shared folder; links never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Links that one task contracts at a time.
AT_ONCE = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for all nodes that aren't their own root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= AT_ONCE:
                yield flush()
    if held:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of long ids -> (u, v): each linked node but the root, and its root.

    A root is its component's smallest id. Nodes without links don't appear; loops and
    repeated links do no harm; no links give no rows.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        links = durable(links.mapInArrow(_contract, "u long, v long"))
        roots = links.select(F.col("v").alias("u")).distinct()
        unsettled = links.join(roots, "u", "left_semi").limit(1).count() or links.groupBy("u").count().where("count > 1").limit(1).count()
        if not unsettled:
            return links.distinct()
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
