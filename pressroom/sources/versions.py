"""Ledgers that are rewritten as a whole. A version is a folder that is never touched
again; a pointer file names the one that counts. Readers follow the pointer, writers
write a new folder first and swap the pointer last, so a write that fails, or is killed,
leaves the old version in force, and nothing is overwritten while it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import ledgers

POINTER = "_CURRENT"


class Versioned:
    """A table below ``path``. One writer at a time: a swap fails if the pointer has moved
    since the writer read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The name of the version in force."""
        pointer = self._at(self.path, POINTER)
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"no version below {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, rows: DataFrame, expected: str | None = None) -> str:
        """Make ``rows`` (which may read the version in force) the new version."""
        expected = expected if expected is not None else self.current()
        name = f"v-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{name}")
            if self.current() != expected:
                raise RuntimeError("another writer has moved the pointer")
            self._swap(name)
        except BaseException:
            self._fs.delete(self._at(self.path, name), True)
            raise
        return name

    def _swap(self, name: str) -> None:
        fresh, pointer = self._at(self.path, f"{POINTER}-{name}"), self._at(self.path, POINTER)
        out = self._fs.create(fresh, True)
        out.write(name.encode())
        out.close()
        # A rename that replaces is one step of the file system: there is always one pointer.
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, pointer, replace)

    def upsert(self, changes: DataFrame, key: str, fields: list[str], order: str | None = None, given: str | None = None) -> str:
        """Apply changes to the version in force (or to nothing) and make the result the
        new one; see ``ledgers.upsert``."""
        name = self.current()
        old = self.read() if name is not None else changes.select(key, *fields).limit(0)
        return self.write(ledgers.upsert(old, changes, key, fields, order, given), name)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all versions but the one in force and the newest ``keep`` - 1 others."""
        now = self.current()
        found = [s for s in self._fs.listStatus(self._at(self.path)) if s.getPath().getName().startswith("v-")]
        old = sorted((s for s in found if s.getPath().getName() != now), key=lambda s: -s.getModificationTime())[max(0, keep - 1) :]
        for s in old:
            self._fs.delete(s.getPath(), True)
        return [s.getPath().getName() for s in old]
