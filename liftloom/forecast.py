"""Several models on one table, model comparison, and keeping models."""

from __future__ import annotations

import io
import json
import pickle

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import CausalFrame
from .operators.curves import lift_at_k, uplift_score
from .plans.lineage import cut
from .sources.tables import result_frame


class ModelSuite:
    """Fits learners on one frame; ``predict`` adds ``uplift_<name>`` columns (with ``components`` also ``<name>_y0_pred``, ``<name>_y1_pred``)."""

    def __init__(self, models: list):
        if not models or not all(hasattr(m, "fit") for m in models):
            raise TypeError("models must be learners")
        names = [m.display_name for m in models]
        if len(set(names)) != len(names):
            raise ValueError(f"models need different names: {names}")
        self.models, self.names, self.fitted = models, names, None

    def fit(self, frame: CausalFrame) -> ModelSuite:
        frame.validated()
        self.fitted = [m.fit(frame) for m in self.models]
        return self

    def predict(self, df: DataFrame, components: bool = False) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("fit first")
        for name, model in zip(self.names, self.fitted, strict=True):
            df = model.predict(df, components, f"uplift_{name}")
            if components:
                df = df.withColumnsRenamed({"y0_pred": f"{name}_y0_pred", "y1_pred": f"{name}_y1_pred"})
        return df

    def save(self, path: str) -> None:
        """The fitted models: Spark models by their writers, tables as Parquet, the rest pickled."""
        save((self.names, self.fitted), path)

    @classmethod
    def load(cls, spark, path: str) -> ModelSuite:
        out = cls.__new__(cls)
        out.names, out.fitted = load(spark, path)
        out.models = []
        if not isinstance(out.names, list) or len(out.names) != len(out.fitted):
            raise TypeError("not a saved forecast")
        return out


def save(thing, path: str) -> None:
    """Write an object whose parts may be Spark models and tables, to any path that Spark writes.  Only load what you trust."""
    spark, path, parts = SparkSession.active(), path.rstrip("/"), []

    class Writer(pickle.Pickler):
        def persistent_id(self, value):
            kind = "table" if isinstance(value, DataFrame) else "model" if hasattr(value, "write") and hasattr(value, "uid") else None
            if kind is None:
                return None
            at = f"part{len(parts)}"
            if kind == "table":
                value.write.mode("overwrite").parquet(f"{path}/{at}")
            else:
                value.write().overwrite().save(f"{path}/{at}")
            parts.append({"kind": kind, "class": f"{type(value).__module__}.{type(value).__name__}"})
            return len(parts) - 1

    data = io.BytesIO()
    Writer(data).dump(thing)
    row = spark.createDataFrame([(bytearray(data.getvalue()), json.dumps(parts))], "data binary, parts string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark, path: str):
    import importlib

    path = path.rstrip("/")
    row = spark.read.parquet(f"{path}/model").first()
    parts = json.loads(row.parts)

    class Reader(pickle.Unpickler):
        def persistent_load(self, at):
            where = f"{path}/part{at}"
            if parts[at]["kind"] == "table":
                return spark.read.parquet(where)
            module, name = parts[at]["class"].rsplit(".", 1)
            return getattr(importlib.import_module(module), name).load(where)

    return Reader(io.BytesIO(bytes(row.data))).load()


METRICS = ("auuc", "qini", "lift")


def compare_models(scored: DataFrame, models: list[str], metrics: tuple[str, ...] = METRICS, k: float = 0.3, outcome: str = "y", treatment: str = "t", row_id: str = "row_id", frame: str = "spark"):
    """(model, arm, a column per metric) from ``uplift_<model>`` columns of ``scored``; all models in the same jobs."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    array = any(dict(scored.dtypes)[f"uplift_{m}"].startswith("array") for m in models)
    entries = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"uplift_{m}").alias("uplift")) for m in models))
    rows = cut(scored.select(row_id, treatment, outcome, F.explode(entries).alias("_m")).select(row_id, treatment, outcome, "_m.*"))
    columns = {"outcome": outcome, "treatment": treatment, "row_id": row_id}
    out = None
    for metric in metrics:
        if metric == "lift":
            part = None
            for m in models:
                one = lift_at_k(rows.where(F.col("model") == m), k, **columns).select(F.lit(m).alias("model"), "arm", "lift")
                part = one if part is None else part.unionByName(one)
        else:
            part = uplift_score(rows, "gain" if metric == "auuc" else "qini", by=("model",), **columns).withColumnRenamed("score", metric)
        out = part if out is None else out.join(part, ["model", "arm"])
    return result_frame(out if array else out.where("arm = 1"), frame)
