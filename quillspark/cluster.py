"""What a cluster needs: this package in Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import io
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local = threading.local()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(top.parent))), p.read_bytes())
    name = f"quillspark-{hashlib.sha256(data.getvalue()).hexdigest()[:12]}.zip"
    path = Path(tempfile.mkdtemp()) / name  # the driver sends it on
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a fresh one in local mode; on a cluster, an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(where)
        return where
    known = sc._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: a stopped write leaves no _SUCCESS."""
    p, fs = _at(spark, f"{path.rstrip('/')}/_SUCCESS")
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, by name; none if it isn't there. What Spark hides (names that begin with _ or a dot) is left out."""
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return []
    found = [f.getPath().toString() for f in fs.listStatus(p)]
    return sorted(f for f in found if not f.rpartition("/")[2].startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder and all in it."""
    p, fs = _at(spark, path)
    fs.delete(p, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may have ended before the interpreter
        pass


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one. What is written there goes when the interpreter ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quillspark-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and the planner learns its size. Goes as folder()'s, or by forget()."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    for held in getattr(_local, "scratch", [])[-1:]:
        held.append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() gave and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that stored() gives inside go at the end, but for those that are passed to what this yields."""
    held, kept = [], set()
    _local.scratch = [*getattr(_local, "scratch", []), held]

    def keep(t: DataFrame) -> DataFrame:
        kept.add(t._stored_at)
        return t

    try:
        yield keep
    finally:
        _local.scratch = _local.scratch[:-1]
        forget(*[t for t in held if t._stored_at not in kept])
        for outer in _local.scratch[-1:]:
            outer += [t for t in held if t._stored_at in kept]
