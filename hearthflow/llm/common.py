"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
    schema: str,
) -> DataFrame:
    """mapInArrow for a generator of {column: values}; the values of one dict have one length."""
    spark = df.sparkSession
    names = spark.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in names])

    def run(batches):
        for out in work(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in the struct `_rest`, where no inner name meets them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others or [F.lit(0)]).alias("_rest"))


def put_back(df: DataFrame, columns: list[str], used: tuple[str, ...], *more) -> DataFrame:
    """The named columns as they were before set_aside, and some more."""
    rest = F.col("_rest")
    return df.select(*(F.col(c) if c in used else rest.getField(c).alias(c) for c in columns), *more)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def spread(*columns, parts: int):
    """A stable number below `parts` from the values of some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def offsets(lengths) -> np.ndarray:
    """Where each of some consecutive pieces begins, and where the last ends."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
