"""Tables that jobs write between rounds, in the folder that all machines share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the cluster's spark.checkpoint.dir, or what the session was told. Only a session
    on one machine that names none gets a temporary one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = tempfile.mkdtemp(prefix="recollect-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Lets a job's shuffle files go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # nothing but this job reads them
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """The tables of a job in rounds: what a round writes replaces what the round before wrote under the same name."""

    def __init__(self):
        self.now: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, name: str = "step") -> DataFrame:
        before, self.now[name] = self.now.get(name), written(df, name)
        if before is not None:
            dropped(before)
        return self.now[name]

    def done(self) -> None:
        dropped(*self.now.values())
        self.now.clear()


def by_range(df: DataFrame, *columns) -> DataFrame:
    """`df` as a table in the order of `columns` over all of its parts, numbered by `part_`: what a scan of everything starts from."""
    from pyspark.sql import functions as F

    return written(df.repartitionByRange(*columns).withColumn("part_", F.spark_partition_id()), "ranges")
