"""Files of the metadata layer, through Hadoop's file systems so that every store Spark reads will do."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from saltmarsh.errors import CommitConflict


class FileInfo(NamedTuple):
    path: str
    size: int
    is_dir: bool
    modified_ms: int


class Storage:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def qualified(self, path: str) -> str:
        return self._fs(path).makeQualified(self._path(path)).toString()

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Makes a whole file under a name that must be free: written beside it, then renamed without overwriting."""
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"  # the folder is made where there is none
        self._write(temporary, text)
        try:
            self.rename(temporary, path)
        except CommitConflict:
            self.delete(temporary)
            raise

    def rename(self, source: str, target: str) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri() if "://" in target else self._path(self.qualified(target)).toUri(), self._conf)
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(options, 0, kinds.NONE)
        try:
            context.rename(self._path(self.qualified(source)), self._path(self.qualified(target)), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"{target} exists") from None
            raise

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def list(self, path: str, recursive: bool = False) -> Iterator[FileInfo]:
        """Files (and folders, unless recursive) by name; a missing folder is empty."""
        if not self.exists(path):
            return
        found = []
        if recursive:
            at = self._fs(path).listFiles(self._path(path), True)
            while at.hasNext():
                found.append(at.next())
        else:
            found = list(self._fs(path).listStatus(self._path(path)))
        yield from sorted(FileInfo(x.getPath().toString(), x.getLen(), x.isDirectory(), x.getModificationTime()) for x in found)

    def directory_info(self, path: str) -> tuple[int, int, int]:
        """Bytes, files and folders below a folder."""
        s = self._fs(path).getContentSummary(self._path(path))
        return s.getLength(), s.getFileCount(), s.getDirectoryCount() - 1
