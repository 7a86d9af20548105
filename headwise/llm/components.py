"""Connected components of things that share groups, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwise.llm.common import written


def components(members: DataFrame) -> DataFrame:
    """Component of each thing: from (group long, k long) to (k, label), label the smallest k of the component.

    A round passes the smallest label of each group to its members, and then each label to the label of its own thing,
    so that long chains shorten by half. Each round is written to the shared folder; only a count reaches the driver. A
    group of any size is aggregated before it is shuffled, and joins on it are split by adaptive execution.
    """
    state = written(members.select("group", "k", F.col("k").alias("label")).distinct(), "components")
    while True:
        groups = state.groupBy("group").agg(F.min("label").alias("group_label"))
        things = state.join(groups, "group").groupBy("k").agg(F.min("group_label").alias("new_label"))
        things = written(things, "component-labels")
        jump = things.select(F.col("k").alias("new_label"), F.col("new_label").alias("far_label"))
        nearer = things.join(jump, "new_label").select("k", "far_label")
        moved = state.join(nearer, "k").select("group", "k", F.col("far_label").alias("label"), (F.col("far_label") != F.col("label")).alias("moved"))
        moved = written(moved, "components")
        if not moved.where("moved").limit(1).count():
            return moved.groupBy("k").agg(F.min("label").alias("label"))
        state = moved.drop("moved")
