"""Running aggregates over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, order: list[Column], values: dict[str, tuple[str, Column]], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with running aggregates up to each row in ``order``, within ``by``.

    ``values``: new column -> (sum, max or min, expression).  Rows are range-partitioned on (by, order);
    each partition aggregates its own rows, and the partitions' totals (a row for each
    partition and group) are accumulated and joined back.  Only those totals meet in one place; no group,
    however large, is sorted by one task.  The order must be total for results to be fixed.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    inputs = {f"_v{i}": e for i, (_, e) in enumerate(values.values())}
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumns(inputs).repartitionByRange(parts, *[F.col(b) for b in by], *order)
    # Written once: the partition numbers below must be those of the same split.
    ranged = cut(ranged.withColumn("_pid", F.spark_partition_id()))
    within = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy("_pid", *by).agg(*(_COMBINE[kind](f"_v{i}").alias(f"_t{i}") for i, (kind, _) in enumerate(values.values())))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *by, *(_COMBINE[kind](f"_t{i}").over(before).alias(f"_b{i}") for i, (kind, _) in enumerate(values.values())))
    local = ranged.select("*", *(_COMBINE[kind](f"_v{i}").over(within).alias(f"_l{i}") for i, (kind, _) in enumerate(values.values())))
    joined = local.join(offsets, ["_pid", *by])
    out = {}
    for i, (name, (kind, _)) in enumerate(values.items()):
        mine, earlier = F.col(f"_l{i}"), F.col(f"_b{i}")
        if kind == "sum":
            out[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        else:
            out[name] = (F.greatest if kind == "max" else F.least)(mine, earlier)
    return joined.withColumns(out).drop("_pid", *keys, *inputs, *(f"_{k}{i}" for i in range(len(values)) for k in "lb"))
