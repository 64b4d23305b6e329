"""One interface over all detection methods."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import labels
from ..features import Scaler
from ..filters import numeric_columns
from ..quantiles import exact_quantiles, weighted_quantile
from . import density, forest, neighbours
from .stats import IQR_MULTIPLIER, PRIMARY, Z_THRESHOLD, ColumnStats, add_zscore_flags

LABELS = {"is_anomaly", "is_extreme", "anomaly_score"}


@dataclass
class AnomalyDetector:
    """Fit on training rows, then detect on any rows.

    Methods: isolation_forest, lof, dbscan, zscore, iqr. Every method is combined with the
    standard score of revenue and amount.
    """

    algorithm: str = "isolation_forest"
    contamination: float = 0.05
    zscore_threshold: float = Z_THRESHOLD
    columns: list[str] = field(default_factory=list)
    key: list[str] | None = None
    scaler: Scaler | None = None
    stats: ColumnStats | None = None
    forest: forest.ForestModel | None = None
    reference: DataFrame | None = None
    index: neighbours.NeighbourIndex | None = None
    threshold: float | None = None
    fences: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> "AnomalyDetector":
        self.columns = columns or self.columns or numeric_columns(df, LABELS)
        self.stats = ColumnStats.fit(df, self.columns + [c for c in PRIMARY if c in df.columns])
        self.scaler = Scaler.fit(df, self.columns)
        if self.algorithm == "lof":
            self.reference, self.index = neighbours.fit(self.scaler.transform(df.select(*self.columns)), self.columns)
            self.threshold = weighted_quantile(self.reference, "lof", "w", 1.0 - self.contamination)
        elif self.algorithm == "iqr":
            q = exact_quantiles(df, {c: [0.25, 0.75] for c in self.columns})
            self.fences = {c: (q[c, 0.25], q[c, 0.75]) for c in self.columns}
        elif self.algorithm not in ("dbscan", "zscore"):
            self.forest = forest.fit_forest(df, self.columns, self.contamination, key=self.key)
        return self

    def transform(self, df: DataFrame, return_scores: bool = True) -> DataFrame:
        """Adds is_anomaly_ml, anomaly_score, standard scores, is_anomaly, severity and severity_z."""
        if self.stats is None:
            raise RuntimeError("this detector has not been fitted")
        missing = [c for c in self.columns if c not in df.columns]
        out = df.withColumns({c: F.lit(0.0) for c in missing}) if missing else df
        if self.algorithm == "lof":
            out = neighbours.score(out, self.reference, self.columns, self.scaler, index=self.index)
            out = out.withColumn("anomaly_score", F.col("lof") - self.threshold).drop("lof")
            out = out.withColumn("is_anomaly_ml", (F.col("anomaly_score") > 0).cast("int"))
        elif self.algorithm == "dbscan":
            names = [f"_s{i}" for i in range(len(self.columns))]
            scaled = out.withColumns({n: self.scaler.expression(c) for n, c in zip(names, self.columns)})
            out = density.noise_flags(scaled, names).drop(*names).withColumn("anomaly_score", F.lit(0.0))
        elif self.algorithm == "zscore":
            sizes = [F.coalesce(F.abs(self.stats.z(c)), F.lit(0.0)) for c in self.columns if self.stats.usable(c)]
            size = F.greatest(*sizes) if len(sizes) > 1 else (sizes[0] if sizes else F.lit(0.0))
            out = out.withColumn("anomaly_score", size)
            out = out.withColumn("is_anomaly_ml", (F.col("anomaly_score") > self.zscore_threshold).cast("int"))
        elif self.algorithm == "iqr":
            outside = [F.greatest(F.lit(q1) - F.col(c), F.col(c) - F.lit(q3), F.lit(0.0)) / (q3 - q1)
                       for c, (q1, q3) in self.fences.items() if q3 > q1]
            size = F.greatest(*outside) if len(outside) > 1 else (outside[0] if outside else F.lit(0.0))
            out = out.withColumn("anomaly_score", size)
            out = out.withColumn("is_anomaly_ml", (F.col("anomaly_score") > IQR_MULTIPLIER).cast("int"))
        else:
            out = forest.detect(out, self.forest)
        out = add_zscore_flags(out, self.stats, self.zscore_threshold)
        z = F.col("is_anomaly_zscore") if "is_anomaly_zscore" in out.columns else F.lit(0)
        out = out.withColumns({"is_anomaly": F.greatest(F.col("is_anomaly_ml"), z),
                               "severity": labels.severity(F.col("anomaly_score"))})
        scores = [F.abs(F.col(f"{c}_zscore")) for c in PRIMARY if f"{c}_zscore" in out.columns]
        if scores:
            size = F.greatest(*scores) if len(scores) > 1 else scores[0]
            out = out.withColumn("severity_z", labels.severity(F.coalesce(size, F.lit(0.0))))
        return (out if return_scores else out.drop("anomaly_score", "severity")).drop(*missing)

    def save(self, spark: SparkSession, path: str) -> str:
        """Small Parquet tables below ``path``; for lof also the scored training points."""
        if self.stats is None:
            raise RuntimeError("only a fitted detector can be saved")
        threshold = self.forest.threshold if self.forest else self.threshold
        spark.createDataFrame([(self.algorithm, self.contamination, self.zscore_threshold, self.columns, threshold)],
                              "algorithm string, contamination double, zscore_threshold double, "
                              "columns array<string>, threshold double").write.parquet(f"{path}/meta")
        self.stats.to_frame(spark).write.parquet(f"{path}/stats")
        self.scaler.to_frame(spark).write.parquet(f"{path}/scaler")
        if self.forest:
            spark.createDataFrame(self.forest.nodes, forest.NODE_SCHEMA).write.parquet(f"{path}/nodes")
        if self.reference is not None:
            self.reference.write.parquet(f"{path}/reference")
        if self.fences:
            spark.createDataFrame([(c, a, b) for c, (a, b) in self.fences.items()],
                                  "feature string, q1 double, q3 double").write.parquet(f"{path}/fences")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyDetector":
        meta = spark.read.parquet(f"{path}/meta").first()
        out = AnomalyDetector(meta.algorithm, meta.contamination, meta.zscore_threshold, list(meta.columns))
        out.stats = ColumnStats.from_frame(spark.read.parquet(f"{path}/stats"))
        out.scaler = Scaler.from_frame(spark.read.parquet(f"{path}/scaler"))
        if out.algorithm == "lof":
            out.reference, out.threshold = spark.read.parquet(f"{path}/reference"), meta.threshold
        elif out.algorithm == "iqr":
            rows = spark.read.parquet(f"{path}/fences").collect()  # one row per column
            out.fences = {r.feature: (r.q1, r.q3) for r in rows}
        elif out.algorithm not in ("dbscan", "zscore"):
            nodes = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()]  # bounded by the model
            out.forest = forest.ForestModel(out.columns, nodes, meta.threshold)
        return out


class MultiDimensionalDetector:
    """Several named feature sets, each with its own detector."""

    def __init__(self):
        self.dimensions: dict[str, AnomalyDetector] = {}
        self.errors: dict[str, str] = {}

    def add_dimension(self, name: str, columns: list[str], algorithm: str = "isolation_forest",
                      key: list[str] | None = None) -> "MultiDimensionalDetector":
        self.dimensions[name] = AnomalyDetector(algorithm, columns=list(columns), key=key)
        return self

    def fit(self, df: DataFrame) -> "MultiDimensionalDetector":
        """A dimension whose columns or key do not suit its method is noted and skipped; other failures, such as lost executors, are raised."""
        for name, detector in self.dimensions.items():
            try:
                detector.fit(df, detector.columns)
            except (ValueError, AnalysisException) as e:
                self.errors[name] = str(e)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``anomaly_<name>``, ``score_<name>``, an any-flag and the number of dimensions that fired."""
        truth = "is_anomaly" in df.columns
        if truth:
            df = df.withColumnRenamed("is_anomaly", "_truth")
        names = []
        for name, detector in self.dimensions.items():
            if name in self.errors:
                continue
            df = detector.transform(df).select(*df.columns, F.col("is_anomaly").alias(f"anomaly_{name}"),
                                               F.col("anomaly_score").alias(f"score_{name}"))
            names.append(name)
        if truth:
            df = df.withColumnRenamed("_truth", "is_anomaly")
        if not names:
            return df
        flags = [F.col(f"anomaly_{n}") for n in names]
        total = sum(flags[1:], flags[0])
        return df.withColumns({"is_multi_anomaly": (total > 0).cast("int"), "anomaly_dimensions": total})
