"""Small files beside tables, over whatever store the path names: what is committed there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share. Only a session on one
    machine may leave ``spark.checkpoint.dir`` unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/quillgate-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Folder:
    """A folder of small files. A file appears whole or not at all, and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def make(self) -> None:
        """Creates the folder itself, where it isn't there."""
        self.fs.mkdirs(self.at)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def names(self) -> list[str]:
        """Names of what is there, but hidden files; none where there is no folder."""
        if not self.fs.exists(self.at):
            return []
        return sorted(n for n in (f.getPath().getName() for f in self.fs.listStatus(self.at)) if not n.startswith((".", "_")))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        source = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> bool:
        """False where another has created it. The content is written under a hidden name; the
        move to its own is one step of the store and fails where the name is taken."""
        hidden = self._path(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(hidden, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            self.context.rename(hidden, self._path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(hidden, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
