"""Connected components of an edge table by rounds of contraction.

In each round every node picks the one of least hash among itself and its neighbours; nodes of one pick are a class. Edges
then lead from class to class, and each task replaces its own by stars, which have fewer edges and the same components.
The hash is another one in each round, so whatever the graph, half the nodes are classes of the next round at most on
average: rounds get smaller by that factor, and few edges are left after a logarithm of rounds. At CONTRACTED edges one
task takes the rest. On the way back each class's component goes to its nodes.

Each task contracts its edges before the first round too, so small inputs need none. Rounds are written to the shared
folder, so a lost executor costs a round's tasks at most. No edge, label or component comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DecimalType, IntegralType, StringType, TimestampType

from .ids import numbered
from .storage import materialise, materialise_counted

#: Rows of one key that one task joins; keys of more rows are hubs.
HUB_ROWS = 1 << 20
#: Edges that a task contracts at once.
CONTRACTED = 1 << 18
#: Types of nodes that Arrow can number.
_NUMBERED = (IntegralType, StringType, BinaryType, DateType, TimestampType, DecimalType)


def hub_join(rows: DataFrame, lookup: DataFrame, key: str, hub_rows: int = HUB_ROWS) -> DataFrame:
    """Inner join of rows with one lookup row per key, whose column n is the number of rows of that key.

    Hubs, keys of over hub_rows rows, are broadcast, so their rows stay where they are; there is at most one hub to
    hub_rows rows. Other keys meet by shuffle, in groups of at most hub_rows rows.
    """
    hubs = F.broadcast(lookup.where(F.col("n") > hub_rows).drop("n"))
    others = rows.join(hubs.select(key), key, "left_anti").join(lookup.drop("n"), key)
    return others.unionByName(rows.join(hubs, key))


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n nodes under the edges a[i] - b[i]."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (above := root[root])).any():
            root = above


def contracted(edges: DataFrame, at_once: int = CONTRACTED, roots: bool = False) -> DataFrame:
    """Edges u, v of the same components, as stars around the smallest node of each at_once edges of a task; roots: with a
    loop for each smallest node. Nodes are of a type in _NUMBERED and not null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            both = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).combine_chunks().dictionary_encode()
            order = pc.sort_indices(both.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            # nodes by rank, so a star's root is its smallest node, as the rounds want it
            nodes, codes = both.dictionary.take(order), rank[np.asarray(both.indices)]
            root = _stars(codes[:size], codes[size:], len(nodes))
            moved = np.arange(len(root)) if roots else np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], ["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= at_once:
                yield done()
                held, size = [], 0
        if size:
            yield done()

    return edges.mapInArrow(work, edges.schema).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _chosen(edges: DataFrame, turn: int) -> DataFrame:
    """For each node u of edges: m, the one of least hash among itself and its neighbours, and n, its number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    of = lambda c: F.xxhash64(F.lit(turn), F.col(c))
    least = both.groupBy("u").agg(F.min(of("v")).alias("h"), F.min_by("v", of("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return least.select("u", F.when(F.col("h") < of("u"), F.col("m")).otherwise(F.col("u")).alias("m"), "n")


def _relabelled(edges: DataFrame, chosen: DataFrame, hub_rows: int) -> DataFrame:
    """Edges between the classes of the two ends."""
    one = hub_join(edges, chosen, "u", hub_rows).select(F.col("m").alias("a"), F.col("v").alias("u"))
    two = hub_join(one, chosen, "u", hub_rows).where(F.col("a") != F.col("m"))
    return two.select(F.greatest("a", "m").alias("u"), F.least("a", "m").alias("v"))


def _labelled(edges: DataFrame, hub_rows: int, at_once: int, max_rounds: int) -> DataFrame:
    """node and component, any node of its component, for every node of edges u > v."""
    current, seen = materialise_counted(contracted(edges, at_once), "components")
    levels = []
    while seen["n"] > at_once:
        if len(levels) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        levels.append(materialise(_chosen(current, len(levels)), "classes"))
        current, seen = materialise_counted(contracted(_relabelled(current, levels[-1], hub_rows), at_once), "components")
    found = contracted(current.coalesce(1), max(1, seen["n"]), roots=True).select(F.col("u").alias("node"), F.col("v").alias("component"))
    if not levels:  # no class was made, so the labels are the smallest nodes
        return found
    for level in reversed(levels):
        top = found.select(F.col("node").alias("m"), "component")
        # a class without edges is whole
        found = materialise(level.join(top, "m", "left").select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component")), "labels")
    least = found.groupBy("component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    return hub_join(found, least, "component", hub_rows).select("node", F.col("least").alias("component"))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60, hub_rows: int = HUB_ROWS, at_once: int = CONTRACTED) -> DataFrame:
    """Return node and component (its smallest node) for every node of an edge; nodes may be of any ordered type.

    Edges with a null end and loops join nothing: a null end is dropped, a loop's node is its own component only if
    another edge names it. Order and repetition of edges do not matter. An empty table gives an empty result.
    """
    a, b = F.col(left), F.col(right)
    proper = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if isinstance(proper.schema["u"].dataType, _NUMBERED):
        return _labelled(proper, hub_rows, at_once, max_rounds)
    # numbers in the order of the nodes stand for them
    proper = materialise(proper, "edges")
    nodes = materialise(numbered(proper.select(F.col("u").alias("x")).union(proper.select("v")).distinct(), ["x"], "id"), "nodes")
    ends = proper.join(nodes.select(F.col("x").alias("u"), F.col("id").alias("i")), "u").join(nodes.select(F.col("x").alias("v"), F.col("id").alias("j")), "v")
    found = _labelled(ends.select(F.col("i").alias("u"), F.col("j").alias("v")), hub_rows, at_once, max_rounds)
    return (
        found.withColumnsRenamed({"node": "i", "component": "j"})
        .join(nodes.select(F.col("x").alias("node"), F.col("id").alias("i")), "i")
        .join(nodes.select(F.col("x").alias("component"), F.col("id").alias("j")), "j")
        .select("node", "component")
    )
