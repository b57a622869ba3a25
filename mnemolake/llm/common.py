"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from mnemolake.work import discard, materialise  # noqa: F401

#: Measured bytes up to which a side may be broadcast; above it the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def broadcast_bytes(df: DataFrame) -> int:
    """An upper estimate of what df takes as a broadcast hash table, from its counted rows and the measured lengths of its values.

    A row is held as key and as value, each with 8 bytes a column and 16 more, in a table of up to 64 bytes an entry.
    """
    loose = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    if any(f.dataType.simpleString().startswith(("array", "map", "struct", "variant")) for f in df.schema.fields):
        raise TypeError("only flat columns can be measured")
    row = df.agg(F.count("*"), *(F.sum(F.octet_length(c) + 8) for c in loose)).first()
    return row[0] * (2 * (16 + 8 * len(df.columns)) + 64) + 2 * sum(x or 0 for x in row[1:])


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint where df is measured to be small; else the join is left to shuffle. df is read twice, so it should be a table."""
    return F.broadcast(df) if broadcast_bytes(df) <= BROADCAST_BYTES else df


def id_remainder(name: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: Rows of a batch that a column function answers at once: what it holds besides the batch stays small.
SLICE = 256


def arrow_map(shape: pa.DataType) -> Callable:
    """Makes a column function out of one that maps a Python value to a value of shape; rows travel as Arrow batches."""

    def wrap(f: Callable) -> Callable:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for first in range(0, len(batch), SLICE):
                    yield pa.array([f(x.as_py()) for x in batch.slice(first, SLICE)], type=shape)
                del batch
                pa.default_memory_pool().release_unused()

        return F.arrow_udf(run, from_arrow_type(shape))

    return wrap
