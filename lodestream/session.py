"""Session set-up, lineage cuts and table loading shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "lodestream", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster, build the session as usual."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or (8 if cpus == "*" else cpus)))
    )
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only in a local session that
    names none a temporary one is made; on a cluster that is an error, as executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestream-"))
    return df.checkpoint(eager=True)


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, *done: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` whose shuffle files go as soon as it is written, and with them the checkpoints ``done``.

    ``done`` are earlier checkpoints that nothing reads any more. For long jobs, whose files would all stay until the end.
    """
    conf = df.sparkSession.conf
    before = conf.get(_TIDY, "false")
    conf.set(_TIDY, "true")
    try:
        out = checkpoint(df.select("*"))
    finally:
        conf.set(_TIDY, before)
    dropped(*done)
    return out


def dropped(*done: DataFrame) -> None:
    """Deletes the files of checkpoints that nothing reads any more."""
    for df in done:
        jvm, plan = df.sparkSession.sparkContext._jvm, df._jdf.queryExecution().logical()
        path = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A checkpointed table of short rows, marked for broadcast if it has at most ``most`` rows; beyond, joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, schema from the parquet footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """Tasks to aim for where an operator has to choose a partition count itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores where it has fewer partitions than there are cores (small input in few files)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
