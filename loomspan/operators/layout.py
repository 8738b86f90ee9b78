"""How rows lie before costly expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it is read in fewer partitions than there are: a table of one small file would keep one
    core busy with all texts. A table of a size that matters has more partitions than cores and stays as it is, and so does
    what a shuffle has dealt out already. Only the plan is looked at."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
