"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import counted, gathered, shuffles_go


def joining(edges: DataFrame) -> DataFrame:
    """``edges``: two columns a and b of longs. Of each task's edges those that join two groups of its nodes: the same
    components, by fewer edges than the task has nodes."""

    def run(batches):
        above: dict[int, int] = {}

        def top(x):
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for batch in batches:
            found = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = top(a), top(b)
                if x != y:
                    above[x] = y
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], pa.int64()) for k in range(2)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``edges``: two columns a and b of one type, without nulls. Returns (node, label), one row for each
    node, where label is the least node that it reaches. ``most``: about how many edges there are, if it is known.

    Each round takes the least label among the neighbours and then the label's label, so a chain of n nodes
    takes about log n rounds. Each round is settled; only the number of changed rows comes to the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both, n = counted(both.union(both.select("b", "a")).distinct(), most and 2 * most)
    labels, n = counted(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), n)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = gathered(hooked.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), n)
        with shuffles_go(moved.sparkSession):
            changed = moved.where("label <> old").count()
        labels = moved.drop("old")
        if not changed:
            return labels
