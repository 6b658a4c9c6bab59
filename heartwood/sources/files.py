"""Small files in the shared folder, through the file system that Spark itself uses for an address."""

from __future__ import annotations

from pyspark.sql import SparkSession


class SharedFiles:
    """A folder of small texts. Its address is any that Spark can open."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self._folder = folder
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, none if there is no such folder."""
        path = self._path(folder)
        return sorted(status.getPath().getName() for status in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if there is one of that name."""
        folder, _, last = name.rpartition("/")
        draft = self._path(f"{folder}/.{last}.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name))

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
