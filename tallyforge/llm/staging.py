"""Intermediate tables in the shared folder, so that a lost executor costs a reread and not a recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files go as soon as the table that they were for is written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session (tests, one machine) gets a temporary
    one, which is then set; on a cluster it must be set, as executors don't share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            folder = jsc.getCheckpointDir().get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="spark-stage-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


class Workspace:
    """The tables of one run of an operator. ``drop`` removes those that are no longer read; at the end of the ``with``
    block all go but those that were given to ``keep``, which the caller's DataFrame still reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.written = 0

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet to the shared folder and read back: later steps start from files, not from lineage."""
        self.written += 1
        path = f"{self.folder}/{self.written}-{name}"
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(SHUFFLE_CLEANUP) if before is None else self.spark.conf.set(SHUFFLE_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Removes the files of ``tables``, which nothing reads any more."""
        gone = {id(t) for t in tables}
        for _, path in (t for t in self.tables if id(t[0]) in gone):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).delete(where, True)
        self.tables = [t for t in self.tables if id(t[0]) not in gone]

    def keep(self, table: DataFrame) -> DataFrame:
        """``table`` stays when the block ends."""
        self.tables = [t for t in self.tables if t[0] is not table]
        return table

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])


def text_of(column: str = "text"):
    """A text column where null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


BITS_A_KEY, MOST_BITS = 16, 1 << 27  #: of a bitmap of keys: its bits for each of them, and the most it has (16 MB)


def maybe_among(rows: DataFrame, column: str, wanted: DataFrame, others: bool = False) -> DataFrame:
    """The ``rows`` whose ``column`` may be in the first column of the staged ``wanted``, and few others, or with
    ``others`` all rows but these. A bitmap of hashes, ``BITS_A_KEY`` for each key, travels to all tasks, so that a join
    which follows shuffles little; beyond ``MOST_BITS`` it would say less and less, and the join alone decides."""
    n = wanted.count()
    if n * BITS_A_KEY > MOST_BITS:
        return rows.filter(F.lit(False)) if others else rows
    bits = 1 << max(16, (n * BITS_A_KEY - 1).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = wanted.select(place(F.col(wanted.columns[0])).alias("k"))
    maps = marks.groupBy(F.bitmap_bucket_number("k").alias("_m_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("_m_bits"))
    told = rows.withColumn("_m_k", place(F.col(column))).withColumn("_m_bucket", F.bitmap_bucket_number("_m_k")).join(F.broadcast(maps), "_m_bucket", "left")
    at = F.bitmap_bit_position("_m_k").cast("int")
    byte = F.conv(F.hex(F.substring("_m_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bitmap_bit_position(_m_k) AS INT) % 8)")) != 0, F.lit(False))
    return told.filter(~hit if others else hit).drop("_m_k", "_m_bucket", "_m_bits")
