"""Connected components of an edge table: contraction inside tasks, then alternating large-star and small-star steps for what several tasks hold.

A task contracts its edges, at most ``RUN`` at a time, to one edge from each node to the least node that those reach. Where all edges fit one run, that is the
result, and takes the driver three jobs' plans instead of two for each star round; else the star rounds connect what the runs leave apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assertia.llm.common import column, dealt, materialize

#: Edges that a task holds at a time, some 100 MB with what is made of them.
RUN = 1 << 20


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    return row.n, row.s


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges that are not the least of their component, and the least nodes."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):  # each round hooks every label that has a lesser neighbour
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contracted(edges: DataFrame, run: int) -> DataFrame:
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            ends = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in contracted(*ends)], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, run):
                part = batch.slice(at, run)
                if held and n + part.num_rows > run:
                    yield out()
                    held, n = [], 0
                held.append([column(part, c).to_numpy(zero_copy_only=False) for c in ("u", "v")])
                n += part.num_rows
        if held:
            yield out()

    return edges.mapInArrow(task, "u long, v long")


def components(edges: DataFrame, run: int = RUN) -> DataFrame:
    """``(node, comp)`` for every node of the edges ``(u, v)``, comp being the least node of its component. Each round is a written
    table; neighbours meet their node's least neighbour by a join, never in a list. Where there are many, joins with the result are not broadcast."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = edges.count()
    edges = materialize(_contracted(edges.coalesce(-(-n // run) or 1), run), "edges")
    seen = None if n <= run else _fingerprint(edges)
    while seen:  # every round but the last lessens the sum of the edges' ends, so this ends; in practice in some log rounds
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(dealt(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least, 2 * n), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    return dealt(found, 2 * n)
