"""Numbered commit files: a table's versions, each created by exactly one of the runs that try."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

DIGITS = 20


class Commits:
    """The commits below a folder, as JSON files named by their number from 1 on.

    A commit appears whole or not at all, and only if its number is free: a local file as a hard
    link, others by a rename that never replaces, which HDFS and its like do in one step. A store
    without such a rename needs a single writer. Talks to Hadoop's file systems through the session's JVM.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _path(self, name: str = "") -> tuple[Any, Any]:
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        path, files = self._path()
        if not files.exists(path):
            return []
        names = (status.getPath().getName() for status in files.listStatus(path))
        return sorted(int(name[:DIGITS]) for name in names if name.endswith(".json") and name[:DIGITS].isdigit())

    def read(self, number: int) -> dict[str, Any]:
        path, files = self._path(f"{number:0{DIGITS}}.json")
        stream = files.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": number}
        finally:
            stream.close()

    def last(self) -> dict[str, Any] | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def create(self, number: int, content: dict[str, Any]) -> bool:
        """Whether this call made the commit; False if the number is taken."""
        temporary, files = self._path(f".{uuid.uuid4().hex}.tmp")
        target, _ = self._path(f"{number:0{DIGITS}}.json")
        stream = files.create(temporary, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        try:
            if files.getScheme() == "file":
                os.link(*(urlparse(str(files.makeQualified(p).toUri())).path for p in (temporary, target)))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
                never = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(temporary, target, never)
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            files.delete(temporary, False)
        return True
