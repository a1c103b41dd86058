"""The folder that all executors share: staged tables and checkpoints live there.

A staged table is an intermediate result written as Parquet and read back. It cuts the lineage, so that the loss
of an executor costs only the tasks of the stage that runs, and it fixes a result that is used more than once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_staged: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process is a temporary folder made; on a cluster a
    machine-local folder would be lost with its machine, so the absence is an error there.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[app])
    return "file://" + _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is put there is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _staged.append((spark, path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged by this thread inside the block are deleted at its end, but for those that ``keep`` was called for."""
    stack = _scopes.__dict__.setdefault("stack", [])
    made: list[tuple[SparkSession, str]] = []
    stack.append(made)
    try:
        yield
    finally:
        stack.pop()
        for spark, path in made:
            _forget(path)
            delete(spark, path)


def keep(staged_df: DataFrame) -> DataFrame:
    """Let a staged table outlive the present scopes; ``drop`` deletes it."""
    for made in getattr(_scopes, "stack", []):
        made[:] = [x for x in made if x[1] != staged_df._staged_at]
    return staged_df


def _forget(path: str) -> None:
    _staged[:] = [x for x in _staged if x[1] != path]


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of Hadoop for a path, so that local and distributed stores are treated alike."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it exists."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Move ``old`` to ``new``; an existing ``new`` is an error."""
    fs, p = hadoop_path(spark, old)
    target = hadoop_path(spark, new)[1]
    if fs.exists(target):  # a rename onto a folder would put the old one inside it
        raise FileExistsError(f"{new} exists")
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot move {old} to {new}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(path, bytes, is folder) of the direct children, sorted by path."""
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted((str(s.getPath().toString()), int(s.getLen()), bool(s.isDirectory())) for s in fs.listStatus(p))


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with options of the Parquet writer, and return what reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop(staged_df: DataFrame) -> None:
    """Delete a staged table that nothing will read any more."""
    keep(staged_df)
    _forget(staged_df._staged_at)
    delete(staged_df.sparkSession, staged_df._staged_at)


@atexit.register
def clear() -> None:
    """Delete all staged tables of this process; results that still read them can then not be computed again.

    Without a session, which may have been stopped before, only folders that this machine sees can be deleted.
    """
    gone = False
    while _staged:
        spark, path = _staged.pop()
        if not gone:
            try:
                delete(spark, path)
                continue
            except Exception:
                gone = True
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
