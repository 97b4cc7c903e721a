"""Causal tables: validation of inputs and decomposition into treated-versus-control pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CausalFrame:
    """A table with a unique row id, a treatment (arms 0..K-1, 0 the control), an outcome and feature columns.

    Rows have no order in Spark, so every operator that the order of rows would decide uses ``row_id``.
    """

    df: DataFrame
    features: tuple[str, ...] = ()
    row_id: str = "row_id"
    treatment: str = "t"
    outcome: str = "y"

    def arms(self) -> list[int]:
        """The arms, sorted; raises unless 0 is the least and there is a treated one."""
        return arms_of(self.df, self.treatment)

    def validated(self) -> CausalFrame:
        """Checks, in one job, for nulls and for arms that are no whole numbers or lack the control."""
        bad = self.df.agg(
            *(F.count_if(F.col(c).isNull()).alias(c) for c in (self.row_id, self.treatment, self.outcome)),
            F.count_if(F.col(self.treatment).cast("double") != F.col(self.treatment).cast("int")).alias("_broken"),
        ).first()
        for name, count in bad.asDict().items():
            if count:
                raise ValueError(f"{count} rows have a null or broken {name}")
        self.arms()
        return self


def arms_of(df: DataFrame, treatment: str) -> list[int]:
    arms = sorted(int(r[0]) for r in df.select(F.col(treatment).cast("int")).distinct().collect())
    if not arms or arms[0] != 0:
        raise ValueError("treatment must have a control arm 0 as its least value")
    if len(arms) < 2:
        raise ValueError("treatment must have at least one treated arm")
    return arms


def check_binary(df: DataFrame, treatment: str) -> None:
    if not df.where(~F.col(treatment).isin(0, 1) | F.col(treatment).isNull()).isEmpty():
        raise ValueError("treatment must be 0 or 1")


def against_control(df: DataFrame, arms: list[int], treatment: str = "t", arm: str = "arm", flag: str = "w") -> DataFrame:
    """Each treated row once for its arm (``flag`` 1), each control row once for every treated arm (``flag`` 0).

    A projection with an explode of a short literal list: no join and no shuffle.
    """
    t = F.col(treatment).cast("int")
    treated = F.array(*(F.lit(a) for a in arms if a != 0))
    return df.withColumn(arm, F.explode(F.when(t == 0, treated).otherwise(F.array(t)))).withColumn(flag, (t != 0).cast("int"))


def arm_value(values: Column, arm: Column) -> Column:
    """The entry of an array of treated arms 1..K-1 for an arm."""
    return F.element_at(values, arm)


def descending(score: str) -> list[Column]:
    """Order by score from high to low with NaN and null last."""
    return [F.coalesce(F.isnan(score), F.lit(True)).asc(), F.col(score).desc()]
