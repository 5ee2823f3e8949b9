"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Removes a finished query's shuffle files, in Spark versions that have it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a session in one process (tests) that names none gets a new local one."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


@contextmanager
def _own_shuffles(spark: SparkSession):
    """Shuffle files of the queries inside are removed as each ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs at most one read
    of it. ``discard`` removes the table when nothing will read it again. ``by``
    names a column to partition the files by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/emberline/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with _own_shuffles(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._emberline_path = path
    return table


#: Bytes of a written table up to which it is broadcast to a join.
SMALL_BYTES = 8 << 20


def written_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table of ``materialise``."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._emberline_path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def small_side(table: DataFrame) -> DataFrame:
    """A table of ``materialise`` for one side of a join: broadcast if its files are small, else as it is."""
    return F.broadcast(table) if written_bytes(table) <= SMALL_BYTES else table


#: Copies of the small side of a salted join.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """``left`` joined to a table of ``materialise`` with one row per key.

    ``right`` is broadcast if its files are small. If not, every key of it goes to
    ``SALTS`` tasks, and rows of ``left`` are dealt among these in turn, so that no
    key's rows meet in one task. Any deal gives the same rows. Keys match null to null.
    """
    keys = [f"_key{i}" for i in range(len(on))]
    small = written_bytes(right) <= SMALL_BYTES
    right = right.withColumnsRenamed(dict(zip(on, keys, strict=True)))
    same = None
    for name, key in zip(on, keys, strict=True):
        test = F.col(name).eqNullSafe(F.col(key))
        same = test if same is None else same & test
    if small:
        return left.join(F.broadcast(right), same, how).drop(*keys)
    left = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt2", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return left.join(right, same & (F.col("_salt") == F.col("_salt2")), how).drop(*keys, "_salt", "_salt2")


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise``; only when no later plan reads them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._emberline_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def share(spark: SparkSession, value):
    """A broadcast of ``value`` as bytes, which hold this package's classes by value; read it with ``shared``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    """The value of ``share`` on a worker."""
    return pickle.loads(broadcast.value)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a table's extra columns never meet ours."""
    return df.select(*[df[f"`{n}`"] for n in names])
