"""CSV, Parquet, JSON, text and point-cloud files: feature tables, benchmark runs, models and reports."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import FEATURE_COLUMNS
from ..operators.forest import FOREST_SCHEMA, read_text, write_text
from ..operators.ingest import numbered
from ..operators.report import MEASURES, nested

INTEGERS = {"node_index", "entity_id", "num_points", "depth", "story_index", "is_near_floor", "is_near_ceiling", "morton_low_8bits", "label"}


def feature_columns_of(columns: list[str], ignore: set[str]) -> list[str]:
    return [c for c in columns if c not in ignore]


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Feature files as text columns with their source file, matched by the names in their headers.

    Paths in order need the columns of the first one, and further ones they may have are left out. Raises ValueError if some are missing.
    """
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
        if not df.columns:
            raise ValueError(f"{path} has no header")
        if out is not None and (missing := sorted(set(out.columns) - {"source_file"} - set(df.columns))):
            raise ValueError(f"{path} is missing columns that earlier files have: {missing}")
        df = df.withColumn("source_file", F.input_file_name())
        out = df if out is None else out.unionByName(df.select(*out.columns))
    return out


def rows_by_file(rows: DataFrame) -> DataFrame:
    """Rows and valid rows of each file, for rows of forest.training_rows()."""
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid_rows"))


def is_training(name: str) -> bool:
    return os.path.basename(name).startswith("train_")


def prediction_files(names: list[str], training: list[str], explicit: list[str] | None = None) -> list[str]:
    """The files to predict: those named, or all CSV files that are neither for training nor results; sorted."""
    if explicit:
        return sorted(explicit)
    return sorted(n for n in names if n.endswith(".csv") and n not in training and not is_training(n) and not os.path.basename(n).startswith("predicted_"))


def prediction_listing(names: DataFrame, training: DataFrame) -> DataFrame:
    """prediction_files() of tables (name), numbered from 0 in order (at, name): no task and no driver holds all names."""
    base = F.regexp_extract("name", r"([^/]*)$", 1)
    known = training.select(F.col("name").alias("name")).distinct()
    wanted = names.select("name").where(F.col("name").endswith(".csv") & ~base.startswith("train_") & ~base.startswith("predicted_"))
    return numbered(wanted.join(known, "name", "left_anti"), ["name"], name="at").select("at", "name")


def feature_text(features: DataFrame) -> DataFrame:
    """Feature rows as a feature file has them: columns in order, numbers with six decimals, the Morton code unsigned."""
    from ..functions.geometry import unsigned

    out = []
    for c in FEATURE_COLUMNS:
        if c == "morton_code":
            out.append(unsigned(F.col(c)).cast("string").alias(c))
        elif c in INTEGERS:
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.format_string("%.6f", F.col(c).cast("double")).alias(c))
    return features.select(*out)


def write_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    feature_text(features).write.mode(mode).option("header", True).csv(path)


def with_external_labels(features: DataFrame, labels: DataFrame, key: str = "node_index") -> DataFrame:
    """Features with label and probability from another table. Raises ValueError unless it has one row for each leaf."""
    joined = features.drop("label", "obstacle_probability").join(labels.select(key, "label", "obstacle_probability"), key)
    n, m, k = features.count(), labels.count(), joined.count()
    if not n == m == k:
        raise ValueError(f"{n} leaves, {m} labels, {k} of them matched")
    return joined


def output_path(base: str, frame: int | None = None, train: bool = False) -> str:
    """A file name with train_ before it and _frameNNNNNN after it where asked for."""
    folder, name = os.path.split(base)
    stem, ext = os.path.splitext(name)
    if train and not stem.startswith("train_"):
        stem = f"train_{stem}"
    return os.path.join(folder, stem + (f"_frame{frame:06d}" if frame is not None else "") + (ext or ".csv"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark runs; blank numbers are null."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    numbers = [F.expr(f"try_cast({c} as double)").alias(c) for c in MEASURES if c in df.columns]
    return df.select(F.expr("try_cast(frame as long)").alias("frame"), "mode", *numbers, F.col("path_success").isin("1", "true", "True").alias("path_success"), *[c for c in ("message",) if c in df.columns])


def append_runs(runs: DataFrame, path: str) -> None:
    """Appends files; each has a header, and texts are quoted where they need it."""
    runs.write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_forest(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Inputs and table of a model in text form."""
    lines = spark.read.text(path, wholetext=True).first()  # one model
    inputs, rows = read_text(lines[0])
    return inputs, spark.createDataFrame(rows, FOREST_SCHEMA)


def write_forest(table: DataFrame, inputs: list[str], path: str) -> None:
    text = write_text([r.asDict() for r in table.collect()], inputs)  # one model
    table.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_forests(model, path: str) -> None:
    """Both forests of a training run with their inputs, in Spark's own format; overwrites."""
    model.classifier.write().overwrite().save(f"{path}/classifier")
    model.regressor.write().overwrite().save(f"{path}/regressor")
    spark = SparkSession.active()
    spark.createDataFrame([(i, c) for i, c in enumerate(model.inputs)], "at int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")


def load_forests(spark: SparkSession, path: str):
    """What save_forests() wrote."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.regression import RandomForestRegressionModel

    from ..operators.forest import Forests

    inputs = [r.name for r in spark.read.parquet(f"{path}/inputs").orderBy("at").collect()]  # a row for each input
    return Forests(RandomForestClassificationModel.load(f"{path}/classifier"), RandomForestRegressionModel.load(f"{path}/regressor"), inputs)


def write_summary(summary: DataFrame, path: str) -> None:
    nested(summary).coalesce(1).write.mode("overwrite").json(path)


def pcd_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> bytes:
    """A binary point-cloud file, version 0.7, of coordinates alone."""
    n = len(x)
    head = f"# .PCD v0.7 - Point Cloud Data file format\nVERSION 0.7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + np.stack([x, y, z], 1).astype("<f4").tobytes()


def pcd_files(points: DataFrame, key: str = "frame_id") -> DataFrame:
    """key, content: a point-cloud file for each frame."""
    import pandas as pd

    def run(k, group):
        return pd.DataFrame([{key: k[0], "content": pcd_bytes(group.x.to_numpy(), group.y.to_numpy(), group.z.to_numpy())}])

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "x", "y", "z").groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


def training_report(counts: DataFrame, metrics: DataFrame, errors: DataFrame, top: DataFrame, inputs: list[str]) -> DataFrame:
    """One row: label counts, class measures, probability errors and importances, for a JSON file."""

    def rows(df: DataFrame) -> DataFrame:
        return df.agg(F.collect_list(F.struct(*df.columns)).alias("_r"))  # a few rows each

    parts = [rows(x).withColumnRenamed("_r", name) for name, x in (("label_counts", counts), ("classes", metrics), ("probability", errors), ("importances", top))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row
    return out.withColumn("inputs", F.array(*[F.lit(c) for c in inputs])).withColumn("trained_at", F.current_timestamp())
