"""Python over rows in Arrow batches, for nested values such as polygons, whose inner arrays differ in length."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that Python handles at once.
ROWS = 256


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: StructType | str) -> DataFrame:
    """The rows that ``fn`` gives for each row, in tasks as df has them; both are dicts by column name."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = [made for row in batch.slice(at, ROWS).to_pylist() for made in fn(row)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, kind)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt to tasks evenly: a small file is read by one, whatever work its rows make."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def with_fields(df: DataFrame, more: str, without: tuple[str, ...] = ()) -> StructType:
    """df's schema without some columns, and fields ``more``."""
    return StructType([f for f in df.schema if f.name not in without] + StructType.fromDDL(more).fields)


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """Names for columns of our own that no column of df, or of a list, has in any case of letters."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    mark = "__"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def joined_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with right's other columns, where columns ``by`` are equal; a null equals a null."""
    names = fresh([*left.columns, *right.columns], *[f"by{k}" for k in range(len(by))])
    other = right.withColumnsRenamed(dict(zip(by, names)))
    on = [left[c].eqNullSafe(F.col(n)) for c, n in zip(by, names)]
    return left.join(other, on, how).drop(*names)
