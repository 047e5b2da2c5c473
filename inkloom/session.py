"""Session helpers: table access, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` of the data folder `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in spark.checkpoint.dir. Only where that is unset (tests, a laptop) a local folder is made.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="inkloom-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def forget(df: DataFrame) -> None:
    """Deletes the checkpoint of a cut frame that nothing will read any more."""
    jvm = df.sparkSession._jvm
    at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        p = jvm.org.apache.hadoop.fs.Path(at.get())
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most `most_rows` rows; reads no more than that many."""
    return df.limit(most_rows + 1).count() <= most_rows


def maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcasting if it has at most `most_rows` rows, else df as it is (a shuffled join)."""
    return F.broadcast(df) if small(df, most_rows) else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors once for each application, so that it need not be installed on them."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        at = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="inkloom-")) / "inkloom"), "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
