"""Connected components over tables of links, without collecting any of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Up to this many links (16 bytes each) are joined up within one task; more, in rounds of joins.
ONE_TASK_LINKS = 1_000_000


def _joined(batches):
    """Links of one partition to ``node, label``: least labels spread along links, paths halved."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
    if not a:
        return
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    for i in range(0, len(nodes), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65_536]), pa.array(nodes[label[i : i + 65_536]])], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``links`` (columns ``a, b``); the label is the least node.

    Alternates hooking (the least label among neighbours) with pointer jumping, so long chains
    halve each round.  Links are contracted to links between labels and vanish once inside one.
    A counted, small table of links is joined up within one task instead.
    """
    if links.count() <= ONE_TASK_LINKS:
        return materialize(links.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, label long"), "labels")
    both = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = materialize(both.select("node", F.col("node").alias("label")), "labels")
    edges = materialize(links.select("a", "b").filter("a != b").distinct(), "edges")
    while not edges.isEmpty():
        # Every label hooks to the least label it is linked to, if that is less.
        two = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = two.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")).select("root", F.least("root", "to").alias("to"))
        hook = materialize(hook, "hooks")
        while True:
            via = hook.select(F.col("root").alias("_r"), F.col("to").alias("_t"))
            jump = hook.join(via, F.col("to") == F.col("_r"), "left").select("root", F.coalesce("_t", "to").alias("next"), "to")
            jump = materialize(jump, "jumps")
            moved = not jump.filter(F.col("next") != F.col("to")).isEmpty()
            discard(edges.sparkSession, hook)
            hook = jump.select("root", F.col("next").alias("to"))
            if not moved:
                break
        h = hook.select(F.col("root").alias("_r"), F.col("to").alias("_t"))
        labels = materialize(labels.join(h, F.col("label") == F.col("_r"), "left").select("node", F.coalesce("_t", "label").alias("label")), "labels")
        ends = edges.join(h, F.col("a") == F.col("_r"), "left").select(F.coalesce("_t", "a").alias("a"), "b")
        ends = ends.join(h, F.col("b") == F.col("_r"), "left").select("a", F.coalesce("_t", "b").alias("b"))
        edges = materialize(ends.filter("a != b").distinct(), "edges")
    return labels


def merge_labels(labels: DataFrame | None, links: DataFrame, every: DataFrame) -> DataFrame:
    """``labels`` after more ``links (a, b)``; nodes without a label are their own.  ``every`` holds all links so far."""
    if labels is None or every.count() <= ONE_TASK_LINKS:
        return components(every)
    old = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    ends = links.join(old, F.col("a") == F.col("_n"), "left").select(F.coalesce("_l", "a").alias("a"), "b")
    ends = ends.join(old, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_l", "b").alias("b"))
    new = components(materialize(ends.filter("a != b").distinct(), "links")).select(F.col("node").alias("_m"), F.col("label").alias("_to"))
    moved = labels.join(new, F.col("label") == F.col("_m"), "left").select("node", F.coalesce("_to", "label").alias("label"))
    fresh = new.join(labels.select("node"), F.col("_m") == F.col("node"), "left_anti").select(F.col("_m").alias("node"), F.col("_to").alias("label"))
    return materialize(moved.unionByName(fresh), "labels")
