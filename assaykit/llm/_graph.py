"""Connected components of an edge table by alternating large-star and small-star rounds, those of a small one in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm._common import discard, materialize

#: Edges up to which one task finds the components: rounds over so few cost the driver more plans, broadcasts and threads
#: than the edges are worth.
SMALL = 1 << 15


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches over the pairs."""
    root = np.arange(n)
    while len(i):
        # Roots alone are hooked, so that a group moves as a whole and an edge that has met stays met.
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def _star(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least node that u meets, itself included."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _star(down)
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        u, v = ([x for b in held for x in b.column(k).to_pylist()] for k in (0, 1))
        nodes = sorted({*u, *v})
        at = {x: k for k, x in enumerate(nodes)}
        root = forest(len(nodes), np.array([at[x] for x in u], np.int64), np.array([at[x] for x in v], np.int64))
        of = held[0].schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, of), pa.array([nodes[r] for r in root.tolist()], of)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(solve, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, rounds: int = 50, small: int = SMALL) -> DataFrame:
    """Per node of an edge: ``node`` and ``root``, the least node of its component. At most ``small`` edges go to one task.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path."""
    now = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = _state(now)
    if 0 < state[0] <= small:
        out = materialize(_in_one_task(now), "components")
        discard(now)
        return out
    for _ in range(rounds):
        if not state[0]:
            break
        after = materialize(_round(now), "edges")
        discard(now)
        now, last, state = after, state, _state(after)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: each node points at its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
