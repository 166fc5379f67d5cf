"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assertia.plans.tables import dealt, fresh_path, shared_dir  # noqa: F401  one definition of the shared folder
from assertia.plans.tables import written as materialize

#: Rows are cut into pieces of about this many text bytes before Python objects are made of them.
SLICE_BYTES = 4 << 20

#: The one column that holds all columns of an input while an operator works beside them, so that no name of the input can clash.
ROW = "row"


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``more``; ``unpacked`` undoes it."""
    return docs.select(F.struct(*(own(c) for c in docs.columns)).alias(ROW), *more)


def unpacked(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(f"{ROW}.*", *more)


def own(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, *labels: str) -> list[str]:
    """Names for new columns, close to the labels, that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for label in labels:
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        out.append(label)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into runs of rows whose ``column`` holds about ``limit`` bytes; a longer row stands alone."""
    for batch in batches:
        n, data = batch.num_rows, batch.column(batch.schema.get_field_index(column))
        if n == 0:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(data), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    data = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in data.cast(pa.binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
