"""Reading the input tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, whose tasks run on this machine, may go without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="keyloom-"))
    return _own_folder[0]


def ship(spark: SparkSession) -> None:
    """Hands this package's modules to the executors, once per application, so that
    functions which run there find them wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_keyloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.writestr(zipfile.ZipInfo(f"{top.name}/{path.relative_to(top)}"), path.read_bytes())
    data = packed.getvalue()
    path = os.path.join(tempfile.mkdtemp(prefix="keyloom-"), f"keyloom-{hashlib.sha256(data).hexdigest()[:12]}.zip")
    Path(path).write_bytes(data)
    context.addPyFile(path)
    context._keyloom_shipped = True


def give_back() -> None:
    """Returns freed memory of this process, a worker that later stages use again or the driver, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch: texts are long, and each task holds a batch twice in the JVM and in Python.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package's modules at hand on the executors, in batches of about
    BATCH_BYTES (a larger limit of the session is lowered, for the frame runs later)."""
    ship(df.sparkSession)
    limit, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(limit)) > BATCH_BYTES:
        conf.set(limit, str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def free_shuffles(spark: SparkSession) -> None:
    """Has the files of finished jobs' shuffles removed now. Spark removes them when the driver's collector finds that
    nothing refers to them any more, which may be long after; jobs that repeat a large shuffle ask for it in between."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables that one query writes to the shared folder.

    ``cut`` writes a frame and returns the written table: later steps read it
    from there, so a lost executor costs a reread and no recomputation, and ids
    made while writing stay as they were written. ``drop`` removes tables that
    no returned frame reads any more. What the returned frame reads stays, for
    the caller may run it at any time; a cluster clears the folder by age.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._tables: list[DataFrame | None] = []  # dropped ones are let go of

    def cut(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{len(self._tables) + 1:03d}-{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)  # no job to infer it, and empty folders have one too
        self._paths[id(table)] = path
        self._tables.append(table)
        return table

    def path(self, table: DataFrame) -> str:
        return self._paths[id(table)]

    def drop_since(self, number: int, *kept: DataFrame) -> None:
        """Removes what was written after the table of that number (see ``written``), but for the kept."""
        stay = {id(t) for t in kept}
        self.drop(*(t for t in self._tables[number:] if t is not None and id(t) in self._paths and id(t) not in stay))

    @property
    def written(self) -> int:
        return len(self._tables)

    def drop(self, *tables: DataFrame) -> None:
        jvm, gone = self.spark._jvm, {id(t) for t in tables}
        self._tables = [None if id(t) in gone else t for t in self._tables]
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
