"""Session helpers: settings the library relies on, and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job sets once; none of them depends on the size of the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # identifiers with leading zeros stay text when they name partitions
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(app: str = "terrapanel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        # one machine, one process: a folder of the session's own, removed when the process ends
        folder = tempfile.mkdtemp(prefix="terrapanel-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    The written rows survive executor loss, and every later use sees the same
    rows, also where row placement depends on sampled range boundaries.
    """
    _checkpoint_dir_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, for wide tables that later steps read in parts.

    Parquet in the shared folder: each later pass reads only its own columns,
    and the file sizes tell Spark which side of a join is small.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "store")
    df.write.parquet(path)
    return mark_settled(spark.read.schema(df.schema).parquet(path))


def mark_settled(df: DataFrame) -> DataFrame:
    """Say that every evaluation of `df` gives the same rows, bit for bit."""
    df._terrapanel_settled = True
    return df


def settled(df: DataFrame) -> DataFrame:
    """`df` evaluated once: itself if it comes from `store`, else stored now.

    A sum of doubles depends on the order in which rows arrive. Where a value
    is compared with a threshold taken from the same column, both have to come
    from one evaluation, or rows at the threshold can flip.
    """
    return df if getattr(df, "_terrapanel_settled", False) else store(df)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """`df` dealt by `cols` over as many tasks as the session has shuffle partitions.

    For steps that make many rows of one, or do much work on it: a file of some MB
    is one task, and adaptive execution joins partitions by the bytes that come in,
    not by what is made of them. A number that is asked for is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable from every executor."""
    _checkpoint_dir_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"
