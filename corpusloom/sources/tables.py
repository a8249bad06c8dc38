"""Reading the Parquet tables of a data directory, and the helpers that every plan shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that Python functions find it there."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        made = Path(tempfile.mkdtemp()) / "corpusloom.zip"
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.is_file() and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(made))  # the driver's file server hands it to every executor
    sc._corpusloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a lazy scan; filters and column choices reach the Parquet reader."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each key: the one with the greatest ``order``; ties fall to the greatest values.

    A null order counts as the oldest. Rows with a null key are dropped. Aggregation combines on the map side,
    so a key that holds a third of all rows is reduced before the shuffle.
    """
    packed = F.struct(F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("_at"), *[F.col(v) for v in values])
    live = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    return live.groupBy(*keys).agg(F.max(packed).alias("_row")).select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder the cluster names.

    A folder of this machine is taken only in local mode with none set, as in tests; a cluster without one is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Splits a scan of fewer parts than there are cores, so that Python work uses them all; a larger scan stays where it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def newest(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """One row for each key, as ``latest``; but only keys with several rows bring their values to a shuffle.

    Keys are counted by themselves; where few repeat, Spark broadcasts them and the other rows stay where the scan put them.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, order, *[v for v in values if v != order])
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return rows.join(again, key, "left_anti").select(key, *values).unionByName(latest(rows.join(again, key, "left_semi"), [key], order, values))
