"""Session helpers shared by all operators: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="kinforge-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir() or at


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors, and gives
    the planner the true size. The files live until drop_stash or the end of the application."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _made.append((spark, at))
    return spark.read.schema(df.schema).parquet(at)


def drop_stash(*frames: DataFrame) -> None:
    """Delete the files behind stashed frames that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            _remove(df.sparkSession, f.rsplit("/", 1)[0])


def _remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, at in _made:
        try:
            _remove(spark, at)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


def stashed_bytes(df: DataFrame) -> int:
    """Bytes of the files a frame reads, as the planner knows them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of a row's parts as a broadcast holds them: fixed for a row and for a value, and for the letters of a text; how much
#: larger than its files a table may be in memory.
ROW_BYTES, VALUE_BYTES, TEXT_BYTES, UNPACKED = 48, 8, 64, 8


def small(df: DataFrame, limit: int = 128 << 20) -> DataFrame:
    """df, which reads a written table, with a broadcast hint if both its files, unpacked, and its rows times their width stay below
    limit bytes, otherwise df as it is. Rows are counted from the files' footers."""
    if stashed_bytes(df) * UNPACKED > limit:
        return df
    width = ROW_BYTES + sum(VALUE_BYTES if t in ("bigint", "int", "double", "boolean") else TEXT_BYTES for _, t in df.dtypes)
    return F.broadcast(df) if df.count() * width <= limit else df
