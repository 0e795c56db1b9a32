"""Shared-folder helpers: every cut of lineage is a table in the folder the cluster names.

The folder is ``spark.checkpoint.dir``. Only a session on one machine may leave it unset (as
in tests); its temporary folder is used then.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Set while a table is written: its shuffle files go when it is there, not when the driver
#: happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for ``name`` under the shared folder; nothing is created."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/quillgate-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within the block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that nothing reads any more. A folder that
    isn't one of :func:`materialise` is left alone."""
    for t in tables:
        spark = t.sparkSession
        root = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/").removeprefix("file:").lstrip("/")
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if root and folder.removeprefix("file:").lstrip("/").startswith(root):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` names for internal columns, with underscores added until none is in ``names``."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
