"""A cleaning and feature plan that is fitted once, stored, and replayed on other tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepflow.functions.columns import local_frame
from prepflow.operators.cleaning import LOG_SCHEMA, CleanSpec, FittedClean, fit_clean
from prepflow.operators.features import FeatureSpec, FeatureStep, FittedFeatures, fit_features


@dataclass
class PrepSpec:
    """What to clean, then what to engineer."""

    clean: CleanSpec = field(default_factory=CleanSpec)
    features: FeatureSpec = field(default_factory=FeatureSpec)

    def to_json(self) -> str:
        return json.dumps({"clean": self.clean.to_dict(), "features": self.features.to_dict()}, default=str)

    @classmethod
    def from_json(cls, text: str) -> "PrepSpec":
        d = json.loads(text)
        return cls(CleanSpec.from_dict(d["clean"]), FeatureSpec.from_dict(d["features"]))

    def fit(self, df: DataFrame) -> "FittedPrep":
        cleaned = fit_clean(df, self.clean)
        engineered = fit_features(cleaned.transform(df), self.features)
        return FittedPrep(self, cleaned, engineered)

    def steps(self, spark: SparkSession) -> DataFrame:
        """The configured steps in the order they run: (step, stage, column, action)."""
        rows = []
        if self.clean.remove_duplicates:
            rows.append(("clean", None, "remove_duplicates"))
        for n, r in self.clean.columns.items():
            if r.null_strategy != "none":
                rows.append(("clean", n, f"nulls: {r.null_strategy}"))
            if r.outlier_strategy != "keep":
                rows.append(("clean", n, f"outliers: {r.outlier_strategy}"))
        f = self.features
        rows += [("features", n, f"datetime: {','.join(p)}") for n, p in f.datetime.items() if p]
        rows += [("features", n, f"encode: {m}") for n, m in f.encoding.items() if m != "none"]
        rows += [("features", n, f"scale: {m}") for n, m in f.scaling.items() if m != "none"]
        rows += [("features", n, "drop") for n in f.drop_cols]
        rows += [("features", n, "log") for n in f.log_transform]
        rows += [("features", n, "sqrt") for n in f.sqrt_transform]
        rows += [("features", n, "square") for n in f.square_transform]
        rows += [("features", f"{a}_x_{b}", "interaction") for a, b in f.interaction_terms]
        rows += [("features", i.name, f"formula: {i.formula}") for i in f.custom_formulas]
        rows += [("features", i.col, f"bin: {i.strategy}") for i in f.binning]
        numbered = [(i, *r) for i, r in enumerate(rows, 1)]
        return local_frame(spark, numbered, "step bigint, stage string, `column` string, action string")


@dataclass
class FittedPrep:
    """A spec with its fitted statistics."""

    spec: PrepSpec
    clean: FittedClean
    features: FittedFeatures

    def transform(self, df: DataFrame, refit: bool = False) -> DataFrame:
        """Apply the stored statistics, or with ``refit`` find new ones on this table first."""
        if refit:
            return self.spec.fit(df).transform(df)
        return self.features.transform(self.clean.transform(df))

    def changelog(self, spark: SparkSession) -> DataFrame:
        rows = self.clean.log_rows() + self.features.log_rows()
        return local_frame(spark, [(i, *r) for i, r in enumerate(rows, 1)], LOG_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the plan below ``path``, on whatever file system Spark uses there."""
        features = []
        for i, step in enumerate(self.features.steps):
            features.append(step.to_dict())
            if step.table is not None:
                step.table.write.parquet(f"{path}/codes-{i}")
        text = json.dumps(
            {"spec": self.spec.to_json(), "clean": self.clean.to_dict(), "features": features}, default=str
        )
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/plan")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedPrep":
        d = json.loads(spark.read.text(f"{path}/plan").first()["value"])
        steps = []
        for i, s in enumerate(d["features"]):
            step = FeatureStep(**s)
            if step.op in ("label", "ordinal", "onehot") and step.classes is None:
                step.table = spark.read.parquet(f"{path}/codes-{i}").select(
                    F.col("__class"), F.col("__code")
                )
            steps.append(step)
        return cls(
            PrepSpec.from_json(d["spec"]), FittedClean.from_dict(d["clean"]), FittedFeatures(steps)
        )
