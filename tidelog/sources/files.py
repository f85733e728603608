"""A table's folder on any Hadoop file system: small files, atomic replacement, locks."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._new_path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._new_path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, replace: bool = False, sync: bool = False) -> None:
        """Write a small file; without ``replace`` fails if it is there (one of several callers wins).

        That is atomic on HDFS and POSIX; an object store needs a file system that makes it so.
        ``sync``: force it to storage.
        """
        self.create_bytes(name, text.encode(), replace, sync)

    def create_bytes(self, name: str, data: bytes, replace: bool = False, sync: bool = False) -> None:
        stream = self._fs.create(self._at(name), replace)
        try:
            stream.write(bytearray(data))
            if sync:
                stream.hsync()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside and rename over: readers see the old text or the new one."""
        temporary = f"{name}.dbtmp"
        self.create(temporary, text, replace=True)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri() if self._at("").toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(self._at(temporary)), context.makeQualified(self._at(name)), options)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
