"""A3: tables whose readers see the old or the new rows, never a part of either.

A write goes to a folder of its own. Two ways make it the table:

* :func:`replace` keeps the plain layout (files under ``path``): the finished folder is moved to the table's place. Until then the old
  table stands untouched, so a job that dies while writing changes nothing. Only between the two moves is there a moment without a table;
  :func:`repaired` puts the old one back if a job died exactly there.
* :func:`publish` has no such moment: versions stand side by side, and an empty file whose name holds a number and the version commits
  one. Creating it is one atomic step on every file system; readers take the highest number. The version before stays for readers that
  already opened it, older ones are deleted.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"
_STAGED, _OLD = "__staged-", "__old-"


class _Files:
    """The few calls on a Hadoop file system that publishing needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return bool(self.fs.exists(self.path(path)))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def move(self, source: str, target: str) -> None:
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def touch(self, path: str) -> None:
        self.fs.create(self.path(path), False).close()


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def _beside(path: str) -> tuple[str, str]:
    folder, _, name = path.rstrip("/").rpartition("/")
    return folder or ".", name


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write df as the plain table at ``path``; the old one stays until the new one is whole."""
    files, path = _Files(df.sparkSession, path), path.rstrip("/")
    folder, name = _beside(path)
    mark = uuid.uuid4().hex
    staged, old = f"{folder}/.{name}{_STAGED}{mark}", f"{folder}/.{name}{_OLD}{mark}"
    repaired(df.sparkSession, path)
    try:
        _write(df, staged, fmt)
        had = files.exists(path)
        if had:
            files.move(path, old)
        files.move(staged, path)
        if had:
            files.delete(old)
    except BaseException:
        repaired(df.sparkSession, path)
        if files.exists(staged):
            files.delete(staged)
        raise
    return path


def repaired(spark: SparkSession, path: str) -> bool:
    """Put the old table back if a job died between the two moves; whether there was something to do."""
    files, path = _Files(spark, path), path.rstrip("/")
    folder, name = _beside(path)
    old = [n for n in files.names(folder) if n.startswith(f".{name}{_OLD}")]
    if not old or files.exists(path):
        return False
    files.move(f"{folder}/{old[-1]}", path)
    return True


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions, the last one the current; empty for a plain or missing table."""
    files = _Files(spark, path)
    return [n.partition("-")[2] for n in files.names(f"{path}/{COMMITS}")]


def current(spark: SparkSession, path: str) -> str:
    """Folder of the table's rows: the last committed version's, or ``path`` itself for a plain table."""
    held = versions(spark, path)
    return f"{path}/{held[-1]}" if held else path


def publish(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write df as a new version of the table and commit it; returns the version's folder.

    Two writers at once both succeed: the later number, or the later name of one number, is the current version.
    """
    spark, files = df.sparkSession, _Files(df.sparkSession, path)
    version = f"v{uuid.uuid4().hex}"
    try:
        _write(df, f"{path}/{version}", fmt)
    except BaseException:
        if files.exists(f"{path}/{version}"):
            files.delete(f"{path}/{version}")
        raise
    commits = files.names(f"{path}/{COMMITS}")
    number = int(commits[-1].partition("-")[0]) + 1 if commits else 1
    files.touch(f"{path}/{COMMITS}/{number:012d}-{version}")
    for name in files.names(f"{path}/{COMMITS}")[:-2]:
        files.delete(f"{path}/{COMMITS}/{name}")
        files.delete(f"{path}/{name.partition('-')[2]}")
    return current(spark, path)
