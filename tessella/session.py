"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for local runs; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    settings = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(session: SparkSession) -> str:
    """The folder all executors share, for checkpoints and written tables.

    ``spark.checkpoint.dir`` is read from the session. Only a session that runs in one process, as in tests, gets a temporary folder where
    none is named; a cluster without one is an error, as its machines don't see each other's folders.
    """
    context = session.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessella-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df by a reliable checkpoint in the shared folder; the files outlive any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def union_all(first: DataFrame, *others: DataFrame, missing: bool = False) -> DataFrame:
    """Rows of all by column name; with ``missing``, absent columns are null.

    Spark 4.1 may zip the partitions of a union's children that are partitioned alike, which fails if adaptive execution
    coalesces them differently; the session setting for that is switched off here.
    """
    first.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=missing)
    return out


#: Bytes of a partition by Spark's estimate of the input.
PARTITION_BYTES = 1 << 26


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df in enough partitions for costly work on its rows.

    With keys it is hash-partitioned by them in as many partitions as the session has cores, or as Spark's estimate of its size needs, if that is more; adaptive execution, going
    by bytes and not by work, would merge them. What follows groups by these keys without another shuffle. Without keys only an
    input of fewer partitions than the session has cores, such as one small file, is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if keys:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(max(cores, min(size // PARTITION_BYTES, 100_000)), *keys)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
