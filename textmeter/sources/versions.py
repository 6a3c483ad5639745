"""Versioned commits: data in a folder of its own, then one pointer per version, created at once or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

POINTER = "version-"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The last committed version and its folder; (0, None) if there is none."""
    place, fs = _place(spark, root)
    if not fs.exists(place):
        return 0, None
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    versions = [int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER)]
    if not versions:
        return 0, None
    last = max(versions)
    folder = spark.read.text(f"{root}/{POINTER}{last:010d}").first().value
    return last, f"{root}/{folder}"


def _publish(spark: SparkSession, root: str, version: int, folder: str) -> bool:
    """Create the version's pointer with its content; False if another writer was first."""
    draft, fs = _place(spark, f"{root}/draft-{uuid.uuid4().hex}")
    pointer, _ = _place(spark, f"{root}/{POINTER}{version:010d}")
    stream = fs.create(draft, False)
    stream.write(bytearray(folder.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() != "file":
            # The target must not be there: one of several writers succeeds.
            return fs.rename(draft, pointer)
        # A local rename replaces its target; a hard link does not.
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(local(pointer), local(draft))
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def commit(spark: SparkSession, root: str, write: Callable[[str | None, str], None]) -> str:
    """The folder of a new version, made by ``write(folder of the version before or None, new folder)``.

    A version counts once its pointer exists, so what a stopped writer left is
    never read. A writer that finds its version taken removes what it wrote and
    writes again on top of the winner's: of two writers at once neither is lost.
    Older versions stay for those who still read them. Needs a file system whose
    rename refuses an existing target (HDFS, local disks), not a bare object store.
    """
    root = root.rstrip("/")
    while True:
        version, before = current(spark, root)
        name = f"data-{uuid.uuid4().hex}"
        folder = f"{root}/{name}"
        write(before, folder)
        if _publish(spark, root, version + 1, name):
            return folder
        place, fs = _place(spark, folder)
        fs.delete(place, True)
