"""Files through Spark's own file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def folders(self, name: str) -> list[str]:
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file as a whole: written beside, then renamed over the old one."""
        context = self._jvm.org.apache.hadoop.fs.FileContext
        part, (_, path) = f"{name}.{uuid.uuid4().hex}", self._at(name)
        fs, beside = self._at(part)
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self._jvm.java.lang.Enum.valueOf(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
        context.getFileContext(path.toUri(), self._conf).rename(beside, path, options)

    def add(self, folder: str, text: str) -> None:
        """A further file of a folder, whose names tell their order."""
        n = len(self._files(folder))
        self.replace(f"{folder}/{n:09d}-{uuid.uuid4().hex[:8]}", text)

    def _files(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(".")) if fs.exists(path) else []

    def all(self, folder: str) -> list[str]:
        """The texts of a folder's files, in the order in which they were added."""
        return [self.read(f"{folder}/{name}") for name in self._files(folder)]

    def delete_on_exit(self) -> None:
        """The whole folder goes when the driver ends."""
        fs, path = self._at("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)
