"""Mixing sources to target weights by Poisson replication.

A source with ``n`` documents and target share ``w`` of ``total`` rows needs a mean repetition
rate of ``w * total / n``.  Each document draws a uniform number from a hash of seed and id, which
the inverse Poisson distribution with that mean turns into a count; the document is exploded by its
count, and all copies are dealt out and ordered by a second hash.  Any executor can recompute any
row: nothing depends on partitions or order.

Defined cases: a null source is a source of its own (named '' in targets); a source without a
target weight takes weight 0 and is dropped; a null id hashes as the empty string; repeated rows
draw the same count each.  Texts are not looked at.  An empty table, or a total of 0, gives no rows.
Columns of the input keep their names and values; ``copy`` and ``rate`` are added, with underscores before
the name where the input has a column so named.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# Up to this mean the sum starts at 0; beyond, where exp(-mean) leaves the doubles, below all counts that can be drawn.
MOST_MEAN = 700.0
BROADCAST_SOURCES = 100_000
SLACK = 12


def uniform(seed: int, label: str, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of seed, label and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(label), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The least k with P(X <= k) >= u for a Poisson X, of any mean."""
    # k lies within 12 sqrt(mean) + 40 of the mean for any u of 52 bits.
    most = F.ceil(mean + SLACK * F.sqrt(mean) + 40).cast("int")
    low = F.greatest(F.floor(mean - SLACK * F.sqrt(mean)).cast("double"), F.lit(1.0))
    # log P(X = low), with Stirling's series for the factorial
    log_p = low * F.log1p((mean - low) / low) - (mean - low) - F.log(2 * math.pi * low) / 2 - 1 / (12 * low) + 1 / (360 * low * low * low)
    large = mean > MOST_MEAN
    least = F.when(large, low.cast("int")).otherwise(0)
    first = F.when(large, F.exp(log_p)).otherwise(F.exp(-mean))
    start = F.struct(first.alias("p"), first.alias("cdf"), (least + F.when(u > first, 1).otherwise(0)).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        cdf = acc["cdf"] + p
        return F.struct(p.alias("p"), cdf.alias("cdf"), (acc["n"] + F.when(u > cdf, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(least + 1, most), start, step, lambda acc: acc["n"])


def poisson_mixing(docs: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 0) and ``rate``, shuffled globally.

    ``targets`` maps sources to weights (any positive scale); without it all sources weigh the
    same.  ``total`` is the expected number of rows; without it the input's.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    name, rate, n, copy, key = (C.unused(label, docs) for label in ("source_name", "rate", "n", "copy", "key"))
    sizes = docs.groupBy(source.alias(name)).agg(F.count(F.lit(1)).alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        if not targets or min(targets.values()) < 0 or not math.isfinite(sum(targets.values())):
            raise ValueError("targets need finite weights of at least 0")
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], f"`{name}` string, weight double")
        weighted = sizes.join(table, name)
    sums = weighted.agg(F.sum("weight").alias("whole"), F.sum("size").alias("rows"))
    want = F.lit(float(total)) if total is not None else (F.col("rows").cast("double"))
    rates = weighted.crossJoin(F.broadcast(sums)).select(name, (F.col("weight") / F.nullif(F.col("whole"), F.lit(0.0)) * want / F.col("size")).alias(rate)).where(F.col(rate) > 0)
    rates = C.cut(rates)
    # One source may hold a third of all rows: with few sources (rows of a name and a number) no row moves for the
    # rates, with many a sort-merge join does it, whose hot partitions AQE splits.
    few = rates.count() <= BROADCAST_SOURCES
    out = docs.withColumn(name, source).join(F.broadcast(rates) if few else rates.hint("merge"), name).drop(name)
    out = out.withColumn(n, inverse_poisson(uniform(seed, "count", F.col(id_col)), F.col(rate))).where(F.col(n) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    drawn = uniform(seed, "order", F.col(id_col), F.col(copy))
    spread = (drawn * (1 << 30)).cast("int")
    out = out.withColumn(key, drawn)
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, spread).sortWithinPartitions(key).drop(key)
