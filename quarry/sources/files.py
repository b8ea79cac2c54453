"""Files through Spark's own file systems, so a store can be local, HDFS or an object store."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def read(self, path: str) -> str | None:
        p, fs = self._path(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none if it isn't there."""
        p, fs = self._path(folder)
        return [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since a file or folder was written."""
        p, fs = self._path(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000

    def create(self, path: str, text: str) -> bool:
        """Write a file aside and rename it to a name that isn't taken, in one step; False if it is."""
        aside, fs = self._path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        target, _ = self._path(path)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, target, none)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def parquet_files(self, folder: str) -> list[str]:
        p, fs = self._path(folder)
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))
