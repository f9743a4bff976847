"""Connected components of an edge table: forests within tasks, joined over rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

_HELD = 500_000  # edges that a task looks at together; bounds its memory


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (least node, other node) that connect what the edges connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[one], label[two])
        new = label.copy()
        for end in (one, two):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)  # roots hook on too, so long paths halve
        while (jumped := new[new]).tobytes() != new.tobytes():
            new = jumped
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label < np.arange(len(nodes)))
    return nodes[label[far]], nodes[far]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(a, b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= _HELD:
            yield flush()
            held = []
    if held:
        yield flush()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): root is the least node reachable, the node itself included.
    Edges from a node to itself and null ones don't count; an empty table gives an empty one.

    A round contracts the edges of each task to stars, deals them by their greater node and contracts again; then what
    hangs on a node that hangs on another itself moves up to that one. Both halve long paths, so rounds grow with the
    logarithm of their length; what is shuffled of a hub's edges is spread by their other ends. Every round is written to
    the shared folder.
    """
    spark = edges.sparkSession
    partitions = shuffle_partitions(spark)
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(most_rounds):
        now = materialize(now.mapInArrow(_contracted, "a long, b long").repartition(partitions, "b").mapInArrow(_contracted, "a long, b long"), "edges")
        # settled when no node has two roots and no root has one itself
        roles = now.select(F.col("a").alias("n"), F.lit(None).cast("long").alias("up")).union(now.select("b", "a"))
        odd = roles.groupBy("n").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max(F.col("up").isNull()).alias("root"))
        moved = materialize(odd.where("least is not null and (root or least < most)").select("n", "least"), "moved")
        if not moved.limit(1).count():
            break
        up = moved.select(F.col("n").alias("a"), F.col("least").alias("up"))
        now = now.join(up, "a", "left").select(F.coalesce("up", "a").alias("a"), "b").union(moved.select(F.col("least").alias("a"), F.col("n").alias("b")))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    settled = now.distinct()
    return settled.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
