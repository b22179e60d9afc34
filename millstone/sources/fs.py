"""Small files on whatever file system Spark uses."""

from __future__ import annotations

import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from millstone.errors import InvalidError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def children(self, path: str) -> list[tuple[str, int]]:
        """(name, time of change in ms) of what lies in a folder."""
        fs, p = self._at(path)
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def write(self, path: str, text: str) -> None:
        """Write or replace a file."""
        fs, p = self._at(path)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that must not exist; false if it does. Readers never see a part of it.

        Of several writers exactly one succeeds: a local file is linked to its name, elsewhere the draft is
        renamed without replacing, which the name node of a distributed file system does in one step.
        An object store must refuse such a rename or creation itself.
        """
        jvm = self._jvm
        fs, p = self._at(path)
        draft = f"{path}.{jvm.java.util.UUID.randomUUID()}.draft"
        fs.mkdirs(p.getParent())
        self.write(draft, text)
        d = jvm.org.apache.hadoop.fs.Path(draft)
        try:
            if fs.getUri().getScheme() == "file":
                link, target = (jvm.java.io.File(x.toUri().getPath()).toPath() for x in (p, d))
                jvm.java.nio.file.Files.createLink(link, target)
            else:
                none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(d, p, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            fs.delete(d, False)
        return True


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on a local master a temporary one otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millstone-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")
