"""What the operators share: the cluster's shared folder, stage outputs, Arrow batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows up to which a written table of a few longs is broadcast, by its count; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see. Where it is unset, a fresh one, but only if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _paths.add(path)
    return path


#: Lets Spark drop an execution's shuffle files when it ends; nothing reads them after a table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this process wrote to the shared folder and has not removed.
_paths: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with bounded(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["quire_path"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` returned; what was made from them must have been written, too."""
    for t in tables:
        if path := t.__dict__.get("quire_path"):
            _remove(t.sparkSession, path)


def written() -> set[str]:
    """The operators' tables that are still in the shared folder."""
    return set(_paths)


def sweep(spark: SparkSession, paths: set[str] | None = None) -> None:
    """Removes these tables, or all, from the shared folder; call it when the results made from them have been read."""
    for path in sorted(_paths if paths is None else paths & _paths):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _paths.discard(path)


#: Rows and bytes of an Arrow batch, since one text may have megabytes and Spark bounds batches by ten thousand rows or 64 MB.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def bounded(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Small Arrow batches for the actions within; the session's own settings come back after."""
    wanted = _BATCH | (more or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """The same for a result that is made only when its reader asks for it: the setting has to last."""
    for k, v in _BATCH.items():
        spark.conf.set(k, v)


def text_of(name: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
