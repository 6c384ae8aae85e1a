"""Small files beside tables, by Hadoop's file contexts: written whole under another name, then renamed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """Small JSON files in the places that Spark reads and writes."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """What is in a folder, in order; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    def state(self, path: str) -> list[tuple[str, int, int]]:
        """Name, length and time of a file, or of the files in a folder."""
        found = self._fs(path).listStatus(self._path(path)) if self.exists(path) else []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def read(self, path: str) -> dict | None:
        """The file's content, None if there is none."""
        if not self.exists(path):
            return None
        stream = self._fs(path).open(self._path(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, path: str, content: dict, over: bool) -> bool:
        """Make the file appear whole. ``over``: in the place of the old one, which is there until then. Else False if there is
        one already, which stays."""
        if not over and self.exists(path):
            return False
        hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(hidden), True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, int(over))
        if over:
            how[0] = kind.OVERWRITE
        qualified = self._fs(path).makeQualified(self._path(path))
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.conf)
        try:
            context.rename(self._fs(path).makeQualified(self._path(hidden)), qualified, how)
        except Exception:
            self.delete(hidden)
            if over or not self.exists(path):
                raise
            return False
        return True
