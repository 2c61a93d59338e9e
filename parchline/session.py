"""Where long jobs keep their intermediate tables.

Lineage is cut by writing a Parquet table to the shared folder that the cluster names in
``spark.checkpoint.dir`` and reading it back: any executor may be lost without losing the step.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Scratch"] = []
_FORGET: list[Callable[[], object]] = []


def forget(what: Callable[[], object]) -> None:
    """To be called when intermediate tables are released."""
    _FORGET.append(what)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where the session names none and runs on this machine alone (tests)."""
    for value in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        if value:
            return value.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="parchline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Named intermediate tables of one operator call.

    ``save`` materialises a frame, ``drop`` removes a step that nothing reads any more. What the returned
    result still reads stays until ``release`` is called or the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._parchline_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_parchline_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session may already be gone
            pass


@atexit.register
def release() -> None:
    """Removes the intermediate tables of all calls so far, and stored indexes. For long sessions, between jobs: results that were not
    written or collected before can no longer be read."""
    while _FORGET:
        _FORGET.pop()()
    while _OPEN:
        _OPEN.pop().close()
