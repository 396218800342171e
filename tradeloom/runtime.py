"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator may broadcast after measuring it.
BROADCAST_LIMIT = 64 * 1024 * 1024


def local_session(name: str = "tradeloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the session's shared folder.

    The folder is ``spark.checkpoint.dir``; only where that is unset (tests, local use) is a
    temporary folder chosen here.  ``localCheckpoint`` is never used, so a lost executor costs
    nothing but the rerun of its tasks.  Jobs run when this is called, so plans with a ``cut``
    do part of their work while they are built.  With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` (set in local sessions) files go when
    nothing refers to them any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tradeloom-"))
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Mark a materialised side for broadcast if its measured size is within ``limit``.

    ``df`` must be cheap to scan twice (a checkpoint or a written table).  Beyond the limit it is
    returned as it is, and the join shuffles.
    """
    width = sum((F.length(F.col(f"`{c}`").cast("string")) if t == "string" else F.length(F.to_json(F.struct(F.col(f"`{c}`")))) for c, t in df.dtypes), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    return F.broadcast(df) if 2 * size.n + 64 * size.k <= limit else df


def sql_text(s: str) -> str:
    """``s`` as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + "'"
