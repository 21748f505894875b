"""Files of table metadata, through the Hadoop file system of any scheme."""

from __future__ import annotations

import contextlib
import os
import uuid
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Item:
    path: str
    name: str
    size: int
    modified_ms: int
    is_dir: bool


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write or replace; not atomic, for files that nobody reads yet."""
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write_hint(self, path: str, text: str) -> None:
        """Write or replace a hint, which many may write and read at a time."""
        if self._at(path)[0].getScheme() != "file":
            self.write(path, text)
            return
        # without the checksum file, which would be replaced apart from its file
        at = Path(self._local(path))
        tmp = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
        tmp.write_text(text)
        at.with_name(f".{at.name}.crc").unlink(missing_ok=True)
        tmp.replace(at)

    def read_hint(self, path: str) -> str | None:
        """The text of a hint, None if there is none or it is just being written."""
        with contextlib.suppress(Py4JJavaError):
            return self.read(path) if self.exists(path) else None
        return None

    def publish(self, path: str, text: str) -> bool:
        """Create the file with all of its text, or return False if it exists."""
        tmp = f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.{uuid.uuid4().hex}"
        self.write(tmp, text)
        fs, p = self._at(path)
        try:
            if fs.getScheme() == "file":
                # a rename would replace here; a hard link never does
                os.link(self._local(tmp), self._local(path))
                return True
            return not fs.exists(p) and fs.rename(self._jvm.org.apache.hadoop.fs.Path(tmp), p)
        except FileExistsError:
            return False
        finally:
            self.delete(tmp)

    @staticmethod
    def _local(path: str) -> str:
        return "/" + path.split(":", 1)[-1].lstrip("/") if path.startswith("file:") else path

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._at(source)
        to = self._jvm.org.apache.hadoop.fs.Path(target)
        fs.mkdirs(to.getParent())
        return fs.rename(p, to)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def list(self, path: str) -> list[Item]:
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [Item(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory()) for s in fs.listStatus(p)]
        return sorted(found, key=lambda i: i.name)

    def walk(self, path: str) -> list[Item]:
        """All files below a folder."""
        out = []
        for i in self.list(path):
            out += self.walk(i.path) if i.is_dir else [i]
        return out
