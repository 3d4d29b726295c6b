"""A stored table of whole versions: a version is written aside and then named by a manifest of its generation."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


class Publication:
    """A folder in which ``publish`` puts versions and from which ``read`` takes that of the highest generation.

    A manifest comes to be by the rename of a finished file to the name of its generation, which happens whole or not at all
    and only if no other writer had that generation (of file systems with such a rename, as HDFS and local ones are). A writer
    that is late can't hide a newer generation: readers take the highest. So no lock is held, and a lost writer leaves nothing
    that a reader sees.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path(os.path.join(self.folder, *parts))

    def generations(self) -> list[int]:
        """Those published, in order."""
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n) for n in names if n.isdigit())

    def publish(self, df: DataFrame, generation: int) -> bool:
        """Write a version and name it; False, and nothing to be read of it, if that generation or a newer one is there."""
        if self.generations()[-1:] and self.generations()[-1] >= generation:
            return False
        version = f"{generation:019d}-{uuid.uuid4().hex}"
        df.write.parquet(os.path.join(self.folder, "versions", version))
        self._fs.mkdirs(self._at("manifests"))
        draft = self._at("manifests", f"_{version}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            out.close()
        name = self._at("manifests", f"{generation:019d}")
        named = not self._fs.exists(name) and self._fs.rename(draft, name)
        if not named:
            self._fs.delete(draft, False)
            self._fs.delete(self._at("versions", version), True)
        return named and self.generations()[-1] == generation

    def read(self) -> DataFrame | None:
        """The version of the highest generation, or None."""
        done = self.generations()
        if not done:
            return None
        lines = self.spark.read.text(self._at("manifests", f"{done[-1]:019d}").toString()).collect()
        version = json.loads(lines[0][0])["version"]
        return self.spark.read.parquet(os.path.join(self.folder, "versions", version))

    def clean(self, keep: int = 2) -> None:
        """Remove all but the ``keep`` newest versions; who reads an older one has to begin again."""
        for generation in self.generations()[:-keep]:
            name = self._at("manifests", f"{generation:019d}")
            version = json.loads(self.spark.read.text(name.toString()).first()[0])["version"]
            self._fs.delete(name, False)
            self._fs.delete(self._at("versions", version), True)
