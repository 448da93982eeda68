"""Session-level helpers: importability on workers, checkpoints, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ROOT = str(Path(__file__).resolve().parent.parent)
#: A side of a join is broadcast when its counted size stays under this; beyond it Spark shuffles both sides.
BROADCAST_LIMIT_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and have a checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a local master (as in tests) gets a temporary folder of its
    own; on a cluster that is an error, as executors have no folder in common.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            made = tempfile.mkdtemp(prefix="vellumkit-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            folder = f"file://{made}"
        sc.setCheckpointDir(folder)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: survives the loss of executors."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder; ``name`` comes last."""
    prepare(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back, so that what follows reads only its columns; with the path."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> bool:
    """Delete a path of the shared folder; whether it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, rows: int = 1 << 12, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, by ``keys`` if given, for work that costs much a row. Spark sizes tasks by bytes, so that a
    million short rows, or one row group, are one task. The rows are counted, and moved only if they need more than one task: select
    the columns first.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def bytes_of(df: DataFrame, row_bytes: int = 40) -> int:
    """Counted size of a table in memory: ``row_bytes`` for each row, and what its strings, binaries and arrays hold."""
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    wide += [16 * F.size(F.coalesce(f"`{f.name}`", F.array().cast(f.dataType))) for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    n, *held = df.agg(F.count("*"), *(F.coalesce(F.sum(w), F.lit(0)) for w in wide)).first()
    return n * row_bytes + sum(held)


def join_checked(big: DataFrame, small: DataFrame, on: list[str] | str, how: str, row_bytes: int = 40) -> DataFrame:
    """Join that broadcasts ``small`` only if its counted size is below the limit; else both sides are shuffled."""
    if bytes_of(small, row_bytes) <= BROADCAST_LIMIT_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
