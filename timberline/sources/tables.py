"""Sources and sinks of labelled tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.functions import prep

#: Rows of a part of a shuffle, about, where there are many, and bytes of files that one task reads then.
PART, READ = 1 << 20, 16 << 20


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_schema(n_features: int, label: T.DataType | None = None) -> T.StructType:
    """``f1..fp`` as doubles, then ``label``."""
    fields = [T.StructField(f"f{i + 1}", T.DoubleType()) for i in range(n_features)]
    return T.StructType([*fields, T.StructField("label", label or T.StringType())])


def delimited(spark: SparkSession, path: str, n_features: int, sep: str = ",", header: bool = False, null: str = "NA") -> DataFrame:
    """A delimited table whose last column is the label; rows with a missing value go. Blank-padded fields are trimmed."""
    reader = spark.read.schema(labelled_schema(n_features)).option("sep", sep).option("header", header).option("nullValue", null)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.csv(path).na.drop("any")


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = False) -> None:
    """The counterpart of ``delimited``: same separator, same header setting."""
    df.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def read_data(spark: SparkSession, path: str, n_features: int, sep: str = ",", header: bool = False, null: str = "NA") -> tuple[DataFrame, list[str], int]:
    """A delimited table ready for a search: points, the features that vary, and the number of classes.

    Points hold ``row_id``, ``f1..fp`` scaled to [0, 1] and ``y``, the label's code from 1. Rows with a missing value
    go, and so do features of one value only. An empty table gives no points, no features and 0 classes.
    """
    names = [f"f{i + 1}" for i in range(n_features)]
    # Ids are given where lines are read, before any shuffle, so that a task run again gives the same.
    rows = delimited(spark, path, n_features, sep, header, null).withColumn("row_id", F.monotonically_increasing_id())
    found, kept = prep.scaled(prep.encode(rows, "label").drop("label"), names)
    classes = found.agg(F.coalesce(F.max("y"), F.lit(0))).first()[0]
    return found.select("row_id", *kept, "y"), kept, int(classes)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one only in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="timberline-")
        atexit.register(shutil.rmtree, own, True)
        shared = f"file://{own}"
    return f"{shared.rstrip('/')}/timberline/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is planned meanwhile, over so many rows, has tasks of some ``PART`` rows and ``READ`` bytes of files at most.

    Spark sizes tasks by bytes, and rows of a few compressed bytes take a hundred each while they are aggregated.
    """
    if rows <= PART:
        yield
        return
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))
    stated = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": str(READ)}
    before = {key: spark.conf.get(key) for key in stated}
    for key, value in stated.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def with_class(rows: DataFrame, classes: DataFrame, key: str, label: str) -> DataFrame:
    """Look each row's class up by ``key``, drop the key, and put the class last. Keys of ``classes`` must be unique.

    Rows without a class go; the smaller side is broadcast only if Spark's own size check allows it.
    """
    twice = classes.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} has several classes")
    named = classes.select(F.col(key), F.col(label).alias("label"))
    others = [c for c in rows.columns if c != key]
    return rows.join(named, key).select(*others, "label")


def covariance(eigenvalues: list[float], seed: int) -> np.ndarray:
    """A symmetric matrix with these eigenvalues in random directions."""
    random = np.random.default_rng(seed)
    directions, _ = np.linalg.qr(random.normal(size=(len(eigenvalues),) * 2))
    return directions @ np.diag(eigenvalues) @ directions.T


def clusters(spark: SparkSession, per_cluster: int = 50, n_clusters: int = 3, n_features: int = 2, seed: int = 1) -> DataFrame:
    """Gaussian clusters ``row_id, f1..fp, label``: integer centres within 1 to 30, covariances from ``covariance``.

    Rows are made where they are kept, in any number; only centres and factors are made on the driver.
    """
    random = np.random.default_rng(seed)
    rows = spark.range(per_cluster * n_clusters).withColumnRenamed("id", "row_id")
    rows = rows.withColumn("label", (F.floor(F.col("row_id") / per_cluster) + 1).cast("int"))
    for j in range(n_features):
        rows = rows.withColumn(f"_z{j}", F.randn(seed * 1000 + j))
    columns = []
    pieces = []
    for _ in range(n_clusters):
        centre = random.integers(1, 31, n_features)
        factor = np.linalg.cholesky(covariance(list(random.uniform(0.5, 6.0, n_features)), int(random.integers(1 << 30))))
        pieces.append((centre, factor))
    for j in range(n_features):
        value = F.lit(None).cast("double")
        for k, (centre, factor) in enumerate(pieces):
            moved = F.lit(float(centre[j]))
            for i in range(j + 1):
                moved = moved + F.lit(float(factor[j, i])) * F.col(f"_z{i}")
            value = F.when(F.col("label") == k + 1, moved).otherwise(value)
        columns.append(value.alias(f"f{j + 1}"))
    return rows.select("row_id", *columns, "label")


def result_line(spark: SparkSession, **values) -> DataFrame:
    """One row of results: name, seconds, objective, bound, gap and accuracies as given."""
    return spark.createDataFrame([tuple(values.values())], list(values))
