"""Tables that change as a whole: a new version is written beside the old ones and becomes current by one rename of a small file, so a
reader has the old state or the new one, and a writer that dies leaves the current one as it was. Snapshots, restores and guarded
changes are versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchline.sources.files import copy_verified


class StaleVersion(RuntimeError):
    pass


class VersionedTable:
    """The versions of a table below ``path``: folders v=1, v=2, ... and ``CURRENT`` with the number of the one that holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def current(self) -> int:
        """The current version, 0 without any."""
        if not self._fs.exists(self._at("CURRENT")):
            return 0
        return int(self.spark.read.text(f"{self.path}/CURRENT").first()[0])

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={version or self.current()}")

    def write(self, df: DataFrame, expected: int | None = None) -> int:
        """Writes and verifies a new version and makes it current. ``expected``: the version that must be current before and after the
        writing, else nothing changes and ``StaleVersion`` is raised."""
        now = self.current()
        if expected is not None and now != expected:
            raise StaleVersion(f"version {now} is current, not {expected}")
        version = max([now, *self.versions()]) + 1
        copy_verified(df, f"{self.path}/v={version}")
        if expected is not None and self.current() != expected:
            self._fs.delete(self._at(f"v={version}"), True)
            raise StaleVersion(f"version {self.current()} became current")
        self._point(version)
        return version

    def restore(self, version: int) -> None:
        """Makes a version that is there current again."""
        if version not in self.versions():
            raise FileNotFoundError(f"v={version}")
        self._point(version)

    def retain(self, keep: int = 14) -> list[int]:
        """Removes all but the newest ``keep`` versions and the current one; the numbers removed."""
        now = self.current()
        gone = [v for v in self.versions()[: -keep or None] if v != now]
        for v in gone:
            self._fs.delete(self._at(f"v={v}"), True)
        return gone

    def _point(self, version: int) -> None:
        out = self._fs.create(self._at("CURRENT.new"), True)
        out.write(bytearray(str(version).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(self._at("CURRENT.new"), self._at("CURRENT"), array)
