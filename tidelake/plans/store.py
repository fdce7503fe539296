"""Small files of metadata on any Hadoop file system, from the driver (O-134, O-156 to O-158)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """Path below the folder, size and time of change in milliseconds, of all files at any depth."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        root, out, it = fs.resolvePath(p).toUri().getPath().rstrip("/"), [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toUri().getPath()[len(root) + 1:], s.getLen(), s.getModificationTime()))
        return sorted(out)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.java.lang.String(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream), "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes a file that mustn't exist, at once or not at all; False if another was there first. A local disk makes a
        hard link, file systems with an atomic rename that doesn't overwrite move a draft."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.draft"
        self.write(draft, text)
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(self._at(draft)[1].toUri().getPath(), p.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return fs.rename(self._at(draft)[1], p)
        finally:
            self.delete(draft)

    def delete(self, path: str, recursive: bool = False) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, recursive)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._at(source)
        return fs.rename(p, self._at(target)[1])

    def qualified(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()
