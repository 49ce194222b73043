"""Shared plumbing: bounded Arrow batches, and the folder every executor shares."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; with long texts the byte bound below is met first.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches sent to Python stay within a few MB whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(df: DataFrame, cols: list[str], rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows`` over every Arrow batch of the named columns only; whatever else df carries is not read."""
    bound_batches(df.sparkSession)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    return df.select(*[df[c] for c in cols]).mapInArrow(each, schema)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Only a local session, as in tests, gets one of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/formloom-checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends here and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
