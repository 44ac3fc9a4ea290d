"""What several operators of this subpackage need."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that Python holds as objects at a time, whatever the size of an Arrow batch.
SLICE = 512


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], Sequence], ddl: str | StructType) -> DataFrame:
    """Apply ``function`` to slices of rows; it returns one list or Arrow array per column of ``ddl``."""
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                columns = function(batch.slice(at, SLICE))
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, field.type)
                        for c, field in zip(columns, arrow, strict=True)
                    ],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def shared_file(spark: SparkSession, path: str) -> Broadcast:
    """Contents of a vocabulary file, which has a few megabytes whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


@lru_cache(maxsize=2)
def parsed_tokenizer(content: bytes):
    """The tokenizer of a file's contents, once per worker, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.transform(F.array(value), function)[0]


def numbered(
    rows: DataFrame, group: str, order: Sequence[str], out: str, bins: int = 256, bin_of: Column | None = None
) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each value of ``group``.

    A group of any size is counted in bins, by default of the hash of ``order``;
    a row's number is the rows in the bins before plus its place in its own bin.
    Rows move once, by (group, bin). Rows equal in ``order`` are numbered in any
    order, so ``order`` should tell rows apart.
    """
    binned = rows.withColumn(
        "_bin", bin_of if bin_of is not None else F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int")
    )
    before = Window.partitionBy(group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(group, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(group).alias("_g"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(group, "_bin").orderBy(*order)
    return (
        binned.withColumn("_place", F.row_number().over(within) - 1)
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")), "left")
        .withColumn(out, F.col("_offset") + F.col("_place"))
        .drop("_bin", "_place", "_g", "_b", "_offset")
    )


def bound_batches(spark: SparkSession, most: int = 32 << 20) -> None:
    """Bound Arrow batches by bytes too, unless the session has a bound: rows may hold whole texts or blocks."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "", "0", "-1", str(2**31 - 1), str(2**63 - 1)):
        spark.conf.set(name, str(most))
