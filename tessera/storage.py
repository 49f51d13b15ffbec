"""Tables in the storage that driver and executors share; they cut the lineage and so survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, only a local master (tests) gets a temporary
    one; a cluster's executors would not see it, so there it is an error. The folder goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    folder, system = _hadoop(spark, path)
    system.deleteOnExit(folder)
    return path


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(sc._jsc.hadoopConfiguration())


def stored(df: DataFrame, codec: str = "zstd", instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df as Parquet in a shared folder and reads it again with the same schema. ``instead_of``: a table of an
    earlier round that is needed no longer; it is deleted once the new one is written."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that ``stored`` gave; what was made of it and not yet stored is lost."""
    if (path := getattr(df, "_stored_at", None)) is not None:
        folder, system = _hadoop(df.sparkSession, path)
        system.delete(folder, True)
