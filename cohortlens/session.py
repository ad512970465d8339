"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, made ready for checkpoints.

    Only a local master without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", ""
        )
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="cohortlens-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` stored in the shared folder, so later stages survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_WRITTEN: dict[tuple[str, ...], str] = {}


def written_once(
    spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table written to the shared folder on first use and read back from there.

    Reading it back, later jobs prune columns and push filters into the scan. The table lives as
    long as the application's checkpoints.
    """
    app = (spark.sparkContext.applicationId, *key)
    if app not in _WRITTEN:
        path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
        build().write.parquet(path)
        _WRITTEN[app] = path
    return spark.read.parquet(_WRITTEN[app])
