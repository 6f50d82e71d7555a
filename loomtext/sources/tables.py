"""Input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame, per_core: int = 2) -> DataFrame:
    """`rows` for work that takes long a row: dealt over the cores where the input comes in fewer splits than they are, as a
    file of a single row group does. Larger inputs keep their splits, so that no shuffle is added."""
    wanted = per_core * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows
