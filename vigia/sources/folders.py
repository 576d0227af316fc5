"""Folders of the session's file system: staged writes that are published by renaming.

Everything goes through Hadoop's file-system interface, so tables may lie wherever Spark can read. Publication
moves whole folders; on stores whose rename copies, it takes as long as the copy, and the old rows stay until
the new ones are in place.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is missing."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _at(spark, new)
    fs.mkdirs(p.getParent())
    if not fs.rename(_at(spark, old)[1], p):
        raise OSError(f"{old} could not be moved to {new}")


@contextlib.contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside ``path`` to write to; what is left of it goes at the end."""
    at = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        remove(spark, at)


def publish(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Put each staged folder in its target's place (a missing one just clears the target); all of them or none."""
    undo, old = [], []
    try:
        for new, target in moves:
            if exists(spark, target):
                aside = f"{new.rstrip('/')}.old-{uuid.uuid4().hex}"
                _move(spark, target, aside)
                old.append(aside)
                undo.append((aside, target))
            if exists(spark, new):
                _move(spark, new, target)
                undo.append((target, new))
    except BaseException:
        for now, before in reversed(undo):
            _move(spark, now, before)
        raise
    for aside in old:
        remove(spark, aside)
