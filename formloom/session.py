"""Session settings the engine relies on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Form expressions contain ${...}, which Spark would replace in SQL text; UTC keeps dates the same on every machine.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variable.substitute": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "formloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session gets one of its own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "/tmp/formloom").rstrip("/")


#: The setting that names the folder of a ``scratch`` block.
SCRATCH = "formloom.scratch.dir"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What operators store within the block lies in one folder, which goes when the block ends: use or write results inside it."""
    path, before = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex[:12]}", spark.conf.get(SCRATCH, None)
    spark.conf.set(SCRATCH, path)
    try:
        yield path
    finally:
        spark.conf.set(SCRATCH, before) if before else spark.conf.unset(SCRATCH)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, what: str, folders: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and its lineage ends here. ``folders``: a column whose values get a folder each."""
    spark, schema = df.sparkSession, df.schema
    path = f"{spark.conf.get(SCRATCH, None) or shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(folders) if folders else df.write).parquet(path)
    return spark.read.schema(schema).parquet(path)
