"""Tables written once in the folder that driver and executors share, and how they go again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders made by us, by application; paths written by us that are still there.
_OWN: dict[str, str] = {}
_PATHS: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing, which is the
    case in tests on one machine.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        _PATHS[_OWN[app]] = None
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table or folder; what is there goes with ``release``, or when the driver ends."""
    path = f"{shared_dir(spark)}/blockloom/{name}-{uuid.uuid4().hex}"
    _PATHS[path] = None
    return path


def few(rows: int) -> int:
    """Tasks for a table of so many narrow rows: enough for small clusters, in proportion beyond."""
    return 6 + rows // 200_000


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    ``tasks`` bounds the files of a small table, which would else be one for each
    shuffle partition.

    Cuts lineage so that a lost executor costs a re-read, not a re-run of all
    that came before.  ``drop`` removes the files as soon as nothing needs them,
    ``release`` all that are left.
    """
    path = new_path(df.sparkSession, name)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._blockloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    for t in tables:
        remove(t._blockloom_path)


def remove(path: str) -> None:
    """Deletes a file or folder in any store that Spark writes to."""
    _PATHS.pop(path, None)
    jvm = SparkContext._gateway.jvm
    session = SparkSession.getActiveSession()
    conf = session._jsc.hadoopConfiguration() if session else jvm.org.apache.hadoop.conf.Configuration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def release() -> None:
    """Removes every table written so far.

    For long sessions, once their results are saved: results that are not yet
    computed read these tables.  Runs by itself when the driver ends.
    """
    for path in list(_PATHS):
        remove(path)


@atexit.register
def _at_end() -> None:
    if not _PATHS or SparkContext._gateway is None:
        return
    try:
        release()
    except Exception:  # the JVM is gone: nothing is left to remove the files with
        _PATHS.clear()
