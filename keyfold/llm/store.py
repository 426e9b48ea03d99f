"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset on a local master (tests), a new local one. On a cluster it must be set: executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        found = f"file://{tempfile.mkdtemp(prefix='keyfold-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")  # nothing reads this job's shuffles once the table is there
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEAN_UP) if before is None else conf.set(_CLEAN_UP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` has made and that nothing will read again."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def as_rows(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``: what is added beside it clashes with no name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def from_rows(df: DataFrame) -> DataFrame:
    """The columns that ``as_rows`` has wrapped, without what was added."""
    return df.select("row.*")
