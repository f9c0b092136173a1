"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one; a cluster needs it set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-stream-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder, so that what follows neither recomputes it nor depends on an executor. Spark removes
    the files when the frame is garbage, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Shuffle files go as soon as the table that they were for is written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, as ``checkpointed``, but what was shuffled for it goes at once. The files stay until someone deletes them."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
