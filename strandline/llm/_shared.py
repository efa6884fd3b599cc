"""What the operators share: the shared folder, lineage cuts, the word class."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Folder that holds the package.
PACKAGE_ROOT = str(Path(__file__).resolve().parents[2])

#: Used only by sessions of one machine (``local[...]``) that name no shared folder.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/strandline"
#: Bytes of one Arrow batch: rows may be long texts, so batches are bounded by size too.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Paths written by :func:`cut` and not yet released.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine gets a local folder; a cluster
    has no folder that all executors see, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("name a folder that all executors see in spark.checkpoint.dir")
        sc.setCheckpointDir(LOCAL_CHECKPOINTS)
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/strandline-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage then starts at files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def uncut(df: DataFrame) -> None:
    """Delete the files of a table of :func:`cut` that nothing will read again."""
    _WRITTEN.remove(df.cut_path)
    _delete(df.sparkSession, df.cut_path)


def release(spark: SparkSession) -> None:
    """Delete all files of :func:`cut` so far: call it when the results that rest on them are stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def spread(df: DataFrame) -> DataFrame:
    """A plain scan of fewer files than cores, dealt over all cores; any other plan as it is.

    Byte ranges of one file help little: a row group, often a whole file, is read by one task.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if re.search(r"^[\s:+-]*(?!Project|Filter|Relation|[\s:+-])\w", plan, re.MULTILINE):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df._jdf.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(said: str) -> int:
    """Number of bytes of a setting such as 8m."""
    m = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", said.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else -1


def words_of(text):
    """Array of the words of a string column; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+")
    return F.filter(parts, lambda w: w != "")


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the Python workers.

    A cluster is given the package as usual (installed, or ``--py-files``); where
    the driver runs from a source tree, its folder is added to the workers' path.
    """
    conf = df.sparkSession.conf
    if not 0 < bytes_of(conf.get(BATCH_CONF)) <= BATCH_BYTES:
        conf.set(BATCH_CONF, BATCH_BYTES)
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    return df.mapInArrow(_tidied(run), schema)


def _tidied(run: Callable) -> Callable:
    """``run``, which at its end gives free memory back: Spark keeps idle workers for the next stage."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return tidy
