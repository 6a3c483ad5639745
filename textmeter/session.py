"""Session construction and the shared folder for written tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "textmeter",
                  folder: str | None = None) -> SparkSession:
    """A single-machine session for tests and benches. Clusters bring their own.

    ``folder`` is where written tables go; by default a temporary one, as
    driver and executors share the machine here.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder or _local_folder())
        .getOrCreate()
    )


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="textmeter-")


def shared_folder(spark: SparkSession) -> str:
    """Where written tables go: the folder the cluster names, never a machine-local one.

    Only a local session that someone else made, where driver and executors
    share one disk, gets a temporary folder; on a cluster an unset folder is an
    error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


#: Paths handed out and not removed yet, by shared folder.
_WRITTEN: dict[str, set[str]] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet.

    The session owns it: ``remove_written`` deletes whatever is left there.
    """
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(shared_folder(spark), set()).add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.get(shared_folder(spark), set()).discard(path)


def remove_written(spark: SparkSession) -> None:
    """Delete every intermediate table of this session; call it when its results have been read."""
    for path in sorted(_WRITTEN.get(shared_folder(spark), ())):
        remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the table once to the shared folder and go on from the files.

    For results several later steps read: they neither repeat the work nor
    depend on executors that may be lost.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a scanned table over all cores, when it lies in fewer files than there are cores.

    A file with a single row group is one task, whatever its size. Only file
    names are looked at, so no job runs, and a table in many files passes
    through as it is. Rows are placed by ``key``: a join on it needs no other
    exchange of this side.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if len(scan.inputFiles()) >= cores else scan.repartition(key)
