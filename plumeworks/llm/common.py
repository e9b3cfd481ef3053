"""What the operators share: reading tables, checkpoints, and Arrow batches of a bounded size."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows that Python handles at once. Spark's own Arrow batches are cut to this.
ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches at 1000 rows and 32 MB at most, so that a run of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where a local session names none, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which cuts the lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, rows: int = ROWS) -> DataFrame:
    """``fn`` over Arrow batches of at most ``rows`` rows each."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
