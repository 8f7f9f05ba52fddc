"""Helpers shared by the corpus operators: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a class body that Java, RE2 and Python read alike.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"
#: A side is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process, as in tests, a temporary folder is used.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="timberline-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timberline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def done(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing needs any more, since all that reads them has been written itself.

    The driver's references to finished shuffles go as well, so that executors delete their files.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def small(df: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` of ``width`` bytes, at most, prove it small, else ``df`` as it is."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an aggregation anew before a join on its key.

    Otherwise the join takes over the aggregation's partitioning, and Spark cannot split a hot key's rows on the
    other side; so both sides are shuffled for the join. The aggregated side has one row a key.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
